import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import mixing
from kindred.plans.tables import materialize
from tests.llm.awkward import ROWS, documents, labels
from tests.llm.test_join_search import brute
from tests.llm.test_packing_fingerprints import check_places, pieces_of

SF = "/root/testdata/sf0.001"


def key(rows):
    return Counter(tuple(r) for r in rows)


def test_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, taken = docs.columns, docs
    by_name = {}
    for name, stage in corpus_pipeline.STAGES:
        by_name[name] = (taken, materialize(stage(spark, taken, SF), name.replace(" ", "_")))
        taken = by_name[name][1]
    for name, (before, after) in by_name.items():
        if name != "best-fit packing":
            assert after.columns == columns
        if name not in ("best-fit packing", "mixing sources"):
            assert not key(after.collect()) - key(before.collect())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = by_name["quality classifier"]
    kept = {r["doc_id"] for r in after.collect()}
    assert all(r["doc_id"] in kept for r in before.collect() if labels.get(r["doc_id"]) == 1)
    assert by_name["language ID"][1].count() >= 0.99 * docs.count()

    before, after = by_name["n-gram Jaccard join"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    groups = {d: g for d, g, *_ in brute(rows)}
    assert sorted(groups[r["doc_id"]] for r in after.collect()) == sorted(set(groups.values()))

    before, after = by_name["mixing sources"]
    want = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(before).collect() if r["copies"]})
    assert Counter(r["doc_id"] for r in after.collect()) == want

    before, after = by_name["best-fit packing"]
    rows = after.collect()
    check_places(rows)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == pieces_of([(r["doc_id"], r["text"]) for r in before.collect()])
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    copies = Counter(r["doc_id"] for r in rows if r["piece"] == 0)
    assert copies == Counter(r["doc_id"] for r in before.collect()) and max(copies.values()) > 1
    assert len({(r["row"], r["piece"]) for r in rows}) == len(rows)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_rows_and_clashing_columns(spark, tmp_path, name, stage):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    given = documents(spark, [*ROWS, *[(20 + i, f"another clean document of plain words with the number {i} in it", "en", "a") for i in range(9)]])
    given = given.withColumns({c: F.lit(f"x{c}") for c in ("lang_pred", "source_size", "target", "_copy", "row", "ids", "_c0", "_p", "node", "sequence_id")})
    out = stage(spark, given, str(tmp_path))
    rows = out.collect()
    if name == "best-fit packing":
        assert sum(r["piece"] == 0 for r in rows) == given.count()
    else:
        assert out.columns == given.columns and len(rows) > 3
        for r in rows:
            assert all(r[c] == f"x{c}" for c in given.columns if c not in ("doc_id", "text", "lang", "source"))
        assert {tuple(r) for r in rows} <= {tuple(r) for r in given.collect()}
    kept = {(r["doc_id"], r["text"]) for r in rows} if "text" in out.columns else set()
    if name == "language ID":
        assert kept and not any(t is None or not any(map(str.isalpha, t)) for _, t in kept)
    if name == "n-gram Jaccard join":
        assert len(rows) == given.count() - 3 and {(1, None), (2, ""), (3, " \n\t ")} <= kept
    assert stage(spark, given.limit(0), str(tmp_path)).count() == 0


def test_run_is_all_stages(spark):
    assert check_places(corpus_pipeline.run(spark, SF).collect()) > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "n-gram Jaccard join", "mixing sources", "best-fit packing"]
