"""The hash cache: merging by one join, and the log of generations."""

import os
import random

import pytest
from pyspark.sql import functions as F

from kindred.plans.scan import scan, scan_rows
from kindred.sources import cache
from kindred.sources.cache import CacheLog
from kindred.streaming.incremental import hash_stream
from tests.test_engine import files, tree

NAMES = list(cache.TYPES)


def entry(path, size=1, mtime=1, at=1, **hashes):
    return {"path": path, "size": size, "mtime_ns": mtime, "inode": None, "created_at": at, **hashes}


def table(spark, entries):
    return spark.createDataFrame([tuple(e.get(n) for n in NAMES) for e in entries], cache.SCHEMA)


def fold(generations):
    """Entry by entry."""
    out = {}
    for entries in generations:
        for e in entries:
            old = out.get(e["path"], {})
            same = (old.get("size"), old.get("mtime_ns")) == (e["size"], e["mtime_ns"])
            row = {n: e.get(n) for n in NAMES}
            for n in (*cache.HASHES, "algo"):
                if row[n] is None and same and not (n == "fullhash" and e.get("prehash") is not None):
                    row[n] = old.get(n)
            out[e["path"]] = row
    return out


def held(df):
    return {r["path"]: r.asDict() for r in df.collect()}


def generations(seed, many, paths=12):
    rng = random.Random(seed)
    out = []
    for g in range(many):
        some = rng.sample(range(paths), rng.randrange(1, paths))
        out.append([entry(f"/p{i}", rng.choice([1, 1, 2]), rng.choice([1, 1, 1, 2]), g, **{h: f"{h}{g}" if i % 2 else f"x{g}" for h in ("prehash", "fullhash") if rng.random() < 0.5}, **({"document_fingerprint": g} if rng.random() < 0.4 else {}), **({"perceptual_hash": -g, "algo": "phash"} if rng.random() < 0.3 else {})) for i in some])
    return out


def reads(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("] parquet")


def test_merging_reads_the_cache_once(spark, tmp_path):
    gens = generations(1, 6)
    table(spark, fold(gens[:3]).values()).write.parquet(str(tmp_path / "c"))
    now = spark.read.schema(cache.SCHEMA).parquet(str(tmp_path / "c"))
    want = fold(gens[:3])
    for g in gens[3:]:
        now = cache.merged(now, table(spark, g))
        want = fold([want.values(), g])
    assert held(now) == want
    assert reads(now) == 1


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_log_is_what_its_upserts_come_to(spark, tmp_path, seed):
    gens = generations(seed, 7)
    log = CacheLog(spark, str(tmp_path / "log"), 4)
    assert log.current().count() == 0
    for i, g in enumerate(gens):
        log.append(table(spark, g))
        if i == 3:
            log.compact()
            assert [p.kind for p in log.live()] == ["base"]
    assert held(log.current()) == fold(gens)
    plan = log.known(spark.createDataFrame([("/p1", 1, 1)], "path string, size long, mtime_ns long"), "prehash", "fullhash", "document_fingerprint")
    assert reads(plan) == 1
    log.compact()
    log.compact()
    assert held(log.current()) == fold(gens) and len(log.parts()) == 5  # a base, what came after it, and the new base
    log.vacuum()
    assert held(log.current()) == fold(gens) and len(os.listdir(tmp_path / "log")) == 1


def written(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_an_upsert_writes_its_entries_only(spark, tmp_path):
    log = CacheLog(spark, str(tmp_path / "log"), 4)
    log.append(table(spark, [entry(f"/{i}", prehash=f"{i:064x}"[::-1]) for i in range(5000)]))
    before, size = set(os.listdir(log.path)), written(log.path)
    log.append(table(spark, [entry("/7", at=2, fullhash="f")]))
    new, = set(os.listdir(log.path)) - before
    assert spark.read.parquet(f"{log.path}/{new}").count() == 1 and written(f"{log.path}/{new}") < size / 10
    row = held(log.current())["/7"]
    assert row["fullhash"] == "f" and row["prehash"] and log.current().count() == 5000


def test_pruned_paths_stay_away(spark, tmp_path):
    log = CacheLog(spark, str(tmp_path / "log"), 3)
    log.append(table(spark, [entry(f"/{i}", at=i, prehash="p") for i in range(9)]))
    log.compact(lambda c: cache.prune_by_age(c, 8, 4))
    assert sorted(held(log.current())) == [f"/{i}" for i in range(4, 9)]
    log.compact(lambda c: cache.prune_stale(c, spark.createDataFrame([("/5",)], "path string")))
    assert list(held(log.current())) == ["/5"]
    log.append(table(spark, [entry("/new", prehash="q")]))
    assert sorted(held(log.current())) == ["/5", "/new"]
    log.compact(lambda c: c.filter("false"))
    assert log.current().count() == 0


def test_half_written_generations_do_not_count(spark, tmp_path):
    log = CacheLog(spark, str(tmp_path / "log"))
    log.append(table(spark, [entry("/a", prehash="p")]))
    log.append(table(spark, [entry("/a", prehash="q")]))
    newest = log.live()[-1]
    os.remove(f"{newest.folder}/_SUCCESS")
    assert held(log.current())["/a"]["prehash"] == "p"


def test_streamed_log(spark, tmp_path):
    schema = "path string, size long, mtime_ns long, inode long, created_at long, content binary"
    log = CacheLog(spark, str(tmp_path / "cache"), 2)
    for n in range(7):
        text = f"text {n}".encode()
        spark.createDataFrame([("/a", 3, n, None, n, text), (f"/{n}", 3, n, None, n, text)], schema).write.parquet(str(tmp_path / "in" / str(n)))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        hash_stream(stream, log, str(tmp_path / "state"), fold_after=2).awaitTermination()
    rows = {r["path"]: r["mtime_ns"] for r in log.current().collect()}
    assert rows == {"/a": 6, **{f"/{n}": n for n in range(7)}}
    assert len(log.parts()) <= 5  # what readers of the last base may read, and what came since
    log.append(table(spark, [entry("/a", at=99, prehash="again")]), batch=3)  # a batch that is folded already
    assert held(log.current())["/a"]["mtime_ns"] == 6


def test_scans_keep_a_log(spark, tmp_path):
    tree(tmp_path / "files", {**{f"{i}.{c}": f"pair {i:03} " * (2 + i % 3 * 600) for i in range(10) for c in "ab"}, "single": "x"})
    log = CacheLog(spark, str(tmp_path / "log"), 4)
    root = [str(tmp_path / "files")]
    assert scan(spark, root, cache=log, now=5).summary.first()["cache_prehash_hits"] == 0
    again = scan(spark, root, cache=log, now=6)
    s = again.summary.first()
    assert (s["cache_prehash_hits"], s["cache_fullhash_hits"], s["duplicate_groups"]) == (20, 20, 10)
    assert {r["created_at"] for r in again.cache.collect()} == {5}
    second = log.parts()[1]
    assert spark.read.schema(cache.SCHEMA).parquet(second.folder).count() == 0  # nothing was new
    (tmp_path / "files" / "0.a").write_text("pair 999 pair 999 ")
    assert scan(spark, root, cache=log, now=7).summary.first()["cache_prehash_hits"] == 19
    assert spark.read.schema(cache.SCHEMA).option("recursiveFileLookup", True).parquet(log.parts()[2].folder).count() == 1


def test_rows_with_content_look_up_once(spark, tmp_path):
    f = files(spark, [("/a", "same", 0), ("/b", "same", 0), ("/c", "other", 0)]).withColumn("mtime_ns", F.lit(1).cast("long"))
    table(spark, [entry("/a", 4, prehash="p", fullhash="f")]).write.parquet(str(tmp_path / "c"))
    got = scan_rows(f, cache=spark.read.schema(cache.SCHEMA).parquet(str(tmp_path / "c")), now=9)
    assert reads(got.cache) == 2  # the cache and the written digests
    rows = held(got.cache)
    assert rows["/a"]["prehash"] == "p" and rows["/b"]["fullhash"] and rows["/b"]["created_at"] == 9 and len(rows) == 3
