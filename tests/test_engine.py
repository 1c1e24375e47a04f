import base64
import io
import json
import os
import random
import re
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import formatting, hashing, paths, preview, progress
from kindred.functions.formatting import format_duration, format_size, parse_date, posix_quoted, truncated_path
from kindred.operators import dedupe, exact, predicates, prefilter, ranking, selection, similar, views
from kindred.operators.graph import components
from kindred.operators.prefilter import BloomFilter
from kindred.plans import scan as scans
from kindred.plans import tables
from kindred.plans.scan import ScanError, find_duplicates, scan, scan_rows
from kindred.plans.tables import materialize
from kindred.schema import ScanOptions
from kindred.sources import actions, cache, config, documents, images, sinks
from kindred.sources import files as file_rows
from kindred.sources.files import from_table, normalized_roots, parse_named_root, walk


def files(spark, rows):
    df = spark.createDataFrame(rows, "path string, text string, minute int")
    return from_table(df, F.col("path"), F.col("text"), F.timestamp_seconds(F.lit(1704067200) + 60 * F.col("minute")))


def test_two_groups(spark):
    f = files(spark, [(f"/1{c}", "group1", 0) for c in "abc"] + [(f"/2{c}", "group2", 0) for c in "ab"] + [("/e1", "", 0), ("/e2", "", 0)])
    found, summary = find_duplicates(f)
    assert found.select("group_id").distinct().count() == 2
    s = summary.first()
    assert (s["duplicate_groups"], s["duplicate_files"], s["reclaimable_space"], s["total_files"]) == (2, 3, 18, 5)


def test_same_prefix_other_tail(spark):
    head = "x" * 4096
    f = files(spark, [("/a", head + "1", 0), ("/b", head + "2", 0), ("/c", head + "1", 0), ("/d", head, 0)])
    assert exact.prehash_candidates(f).count() == 1
    assert [r["path"] for r in exact.exact_members(f).orderBy("path").collect()] == ["/a", "/c"]


def moved(df):
    """The columns that the exchanges of a plan move."""
    out, todo = set(), [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.initialPlan())
        if "Exchange" in name:
            out |= {node.output().apply(i).name() for i in range(node.output().size())}
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


@pytest.mark.parametrize("paranoid", [False, True])
def test_content_is_never_shuffled(spark, tmp_path, monkeypatch, paranoid):
    """Of all plans that are written, at more cores than parts, none moves or keeps a content."""
    rows = files(spark, [(f"/{i}", f"text {i % 3}", 0) for i in range(9)]).coalesce(1)
    rows.write.parquet(str(tmp_path / "f"))
    f = spark.read.parquet(str(tmp_path / "f"))
    assert f.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    written = []

    def noted(df, tag, rows=None):
        written.append((tag, set(df.columns), moved(df)))
        return materialize(df, tag, rows)

    for module in (exact, scans, similar, ranking):
        monkeypatch.setattr(module, "materialize", noted, raising=False)
    small = scan_rows(f, ScanOptions(similar_documents=True, paranoid=paranoid)).members.collect()
    assert any("content" in columns for _, _, columns in written)  # this input is small enough to be dealt out
    monkeypatch.setattr(tables, "SPREAD_BYTES", 0)
    written.clear()
    got = scan_rows(f, ScanOptions(similar_documents=True, paranoid=paranoid)).members
    assert sorted(map(str, got.collect())) == sorted(map(str, small))
    assert len(written) >= 4
    for tag, kept, columns in [*written, ("members", set(got.columns), moved(got))]:
        assert not {"content", "text"} & (kept | columns), tag


def test_small_inputs_are_spread(spark, monkeypatch):
    one = spark.range(10).coalesce(1)
    assert tables.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(tables, "SPREAD_BYTES", 1)
    assert tables.spread(one).rdd.getNumPartitions() == 1


def test_progress_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(ranking, "HOT_ROWS", 50)
    rows = [(k, i, float(i * 7 % 13) if i % 9 else None) for k, n in (("hot", 400), ("a", 3), ("b", 1)) for i in range(n)]
    want = {}
    for k, _, v in rows:
        if v is not None:
            ema, n = want.get(k, (None, 0))
            want[k] = (v if ema is None else ema + 0.1 * (v - ema), n + 1)
    df = spark.createDataFrame(rows, "k string, at int, rate double")
    got = {r["k"]: (r["ema"], r["samples"]) for r in progress.smoothed(df.repartition(7), ["k"], ["at"], "rate").collect()}
    assert got == {k: (pytest.approx(e), n) for k, (e, n) in want.items()}


def test_progress_of_a_stream(spark, tmp_path):
    rows = [("a" if i % 3 else "b", i, float(i)) for i in range(30)]
    seen = {}
    for part in range(3):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], "k string, at int, rate double").write.parquet(str(tmp_path / "in" / str(part)))
        stream = spark.readStream.schema("k string, at int, rate double").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        told = progress.smoothed_stream(stream, "k", "at", "rate").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
        told.foreachBatch(lambda df, _: seen.update({r["key"]: (r["ema"], r["samples"]) for r in df.collect()})).trigger(availableNow=True).start().awaitTermination()
    whole = {r["k"]: (pytest.approx(r["ema"]), r["samples"]) for r in progress.smoothed(spark.createDataFrame(rows, "k string, at int, rate double"), ["k"], ["at"], "rate").collect()}
    assert seen == whole


def test_paranoid_tells_contents_of_one_hash_apart(spark, monkeypatch):
    monkeypatch.setattr(exact, "fullhash", lambda content: F.lit("h"))
    f = files(spark, [("/a", "one", 0), ("/b", "two", 0), ("/c", "one", 0), ("/d", "two", 0), ("/e", "six", 0)])
    assert exact.exact_members(f).count() == 5
    got = {(r["path"], r["rank_in_group"]) for r in exact.exact_members(f, paranoid=True).collect()}
    assert got == {("/a", 1), ("/c", 2), ("/b", 1), ("/d", 2)}


@pytest.mark.parametrize("rate", [0.1, 0.01, 0.0001])
def test_bloom_filters_lose_nothing_and_hold_their_rate(spark, rate):
    keys = spark.range(3000).select((F.col("id") * 7).alias("a"), F.col("id").cast("string").alias("b"))
    held = BloomFilter.of(keys, rate)
    assert keys.filter(~held.may_hold(keys, "a", "b")).count() == 0
    others = spark.range(60_000).select((F.col("id") * 7 + 1).alias("a"), F.col("id").cast("string").alias("b"))
    passed = others.filter(held.may_hold(others, "a", "b")).count() / 60_000
    assert passed <= 2 * rate + 1e-4 and held.rate == pytest.approx(rate, rel=0.2)
    none = BloomFilter.of(keys.limit(0))
    assert none.rate == 0 and keys.filter(none.may_hold(keys, "a", "b")).count() == 0


def test_long_lists_are_sent_as_filters(spark, monkeypatch):
    monkeypatch.setattr(exact, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(prefilter, "MOST_BITS", 1 << 9)  # so full that much passes
    rows = files(spark, [(f"/{i}", "x" * (1 + i % 60 if i < 120 else i), 0) for i in range(200)])
    got = exact.same_size(rows)
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["path"] for r in got.collect()) == sorted(f"/{i}" for i in range(120))


def test_hot_groups_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ranking, "HOT_ROWS", 7)
    rows = [("hot" if i % 2 else f"k{i % 6}" if i % 5 else None, f"p{i:03}") for i in range(120)]
    got = {(r["k"], r["p"]): r["n"] for r in ranking.ranked(spark.createDataFrame(rows, "k string, p string"), ["k"], ["p"], "n").collect()}
    groups = {}
    for k, p in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(k, []).append(p)
    assert got == {(k, p): i + 1 for k, ps in groups.items() for i, p in enumerate(ps)}
    numbers = {r["p"]: r["n"] for r in ranking.numbered(spark.createDataFrame(rows + rows, "k string, p string"), "p", "n").collect()}
    assert numbers == {p: i + 1 for i, p in enumerate(sorted(p for _, p in rows))}


def test_similar_but_not_exact(spark):
    base = "one two three four five six seven eight nine ten " * 30
    f = files(spark, [("/a.txt", base, 0), ("/b.txt", base, 0), ("/c.txt", base.upper(), 0), ("/d.txt", "something else altogether it is", 0)])
    found, _ = find_duplicates(f, ScanOptions(similar_documents=True))
    kinds = {(r["path"], r["is_similar"]) for r in found.collect()}
    assert kinds == {("/a.txt", False), ("/b.txt", False), ("/a.txt", True), ("/b.txt", True), ("/c.txt", True)}


def test_similar_fixture_distances():
    t1 = "the quick brown fox jumps over the lazy dog it was a sunny day in the park"
    t3 = "rust is a systems programming language that provides memory safety without garbage collection"
    d = lambda a, b: ((hashing.simhash_of(a) ^ hashing.simhash_of(b)) & (2**64 - 1)).bit_count()
    assert 0 < d(t1, t1.replace("lazy", "active")) < d(t1, t3)
    assert hashing.simhash_of("") == hashing.simhash_of(None) == 0


@pytest.mark.parametrize("most,many", [(0, None), (3, None), (3, 10**9)])
def test_hamming_pairs_are_complete(spark, most, many):
    rng = random.Random(most)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = sorted({(b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4)))) & (2**64 - 1) for b in base for _ in range(6)})
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    found = [(r["hash_a"], r["hash_b"]) for r in similar.hamming_pairs(spark.createDataFrame([(v,) for v in signed], "hash long"), most, many).collect()]
    got = set(found)
    assert len(got) == len(found)
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= most}
    assert got == want


def test_more_values_take_more_bands():
    assert similar.bands_for(10, 3) == 4 < similar.bands_for(10**9, 3)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filters(spark):
    rows = [("/r/test.tmp", "dup", 0), ("/r/test.log", "dup", 0), ("/r/keep.txt", "dup", 0), ("/r/keep2.txt", "dup", 0), ("/r/ignored/file.txt", "dup", 0), ("/r/.x/a.txt", "dup", 0)]
    f = files(spark, rows).withColumn("root", F.lit("/r"))
    names = lambda o: {r["path"] for r in predicates.passed(f, o).collect()}
    assert names(ScanOptions(ignore=("*.tmp", "*.log", "ignored/**"), skip_hidden=True)) == {"/r/keep.txt", "/r/keep2.txt"}
    assert names(ScanOptions(include=("^(keep|test)",), exclude=("test",))) == {"/r/keep.txt", "/r/keep2.txt"}


@pytest.mark.parametrize("pattern,path,hit", [("*.log", "a/b.log", True), ("/x", "a/x", False), ("a/**/c", "a/c", True), ("a/*/c", "a/b/b/c", False), ("d/", "d/e", True), ("f[0-9]", "f7", True), ("f[!0-9]", "f7", False)])
def test_globs(pattern, path, hit):
    import re

    assert bool(re.search(paths.glob_regex(pattern)[0], path)) == hit


def tree(top, files):
    for name, text in files.items():
        p = top / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return top


def names(df):
    return sorted(os.path.basename(r["path"]) for r in df.select("path").collect())


def test_walk(spark, tmp_path):
    tree(tmp_path, {"a/x.txt": "same", "a/deep/.hidden": "same", "b/y.txt": "other", "top": "same", "empty": ""})
    os.link(tmp_path / "top", tmp_path / "top2")
    os.symlink(tmp_path / "top", tmp_path / "link")
    os.symlink(tmp_path, tmp_path / "b" / "circle")
    found, errors = walk(spark, [str(tmp_path), str(tmp_path / "a"), str(tmp_path / "none")])
    assert names(found) == sorted(["x.txt", ".hidden", "y.txt", "top", "top2", "empty"])
    assert {os.path.basename(r["path"]) for r in found.filter("is_hardlink").collect()} == {"top", "top2"}
    assert errors.count() == 0 and "content" not in found.columns
    assert normalized_roots([str(tmp_path / "a"), str(tmp_path), str(tmp_path)]) == [os.path.realpath(tmp_path)]
    members, _ = find_duplicates(found)
    assert names(members) == [".hidden", "top", "x.txt"]  # one name of the linked file
    followed, _ = walk(spark, [str(tmp_path)], follow_symlinks=True)
    assert followed.count() == 6 and followed.select("canonical_path").distinct().count() == 6


def test_walk_of_many_folders_is_many_tasks(tmp_path, monkeypatch):
    monkeypatch.setattr(file_rows, "TASKS", 9)
    tree(tmp_path, {f"only/{i}/{j}/f": "x" for i in range(4) for j in range(4)})
    reader = file_rows._Walk({"roots": str(tmp_path)})
    parts = reader.partitions()
    assert sum(p.deep for p in parts) >= 9
    assert len({r[0] for p in parts for r in reader.read(p)}) == sum(1 for p in parts for _ in reader.read(p)) == 16


def test_hard_links_are_no_duplicates(spark, tmp_path):
    tree(tmp_path, {"one": "the content", "z": "another content"})
    os.link(tmp_path / "one", tmp_path / "two")
    got = scan(spark, [str(tmp_path)])
    assert got.members.count() == 0 and got.summary.first()["total_files"] == 2
    files_of = got.files.filter("is_hardlink")
    assert names(files_of) == ["one"]


def test_only_files_that_may_be_equal_are_opened(spark, tmp_path):
    """Files of one size alone are not opened, and those whose first bytes differ are not read on."""
    head = b"h" * 4096
    tree(tmp_path, {"a": head + b"1" * 10, "b": head + b"1" * 10, "c": head + b"2" * 10, "d": b"x" * 4096 + b"3" * 10, "e": "short", "f": "shirt", "g": "short", "alone": "a size of its own"})
    found, _ = walk(spark, [str(tmp_path)])
    found = found.withColumn("path", F.when(F.col("path").endswith("alone"), F.lit("/nowhere/alone")).otherwise(F.col("path")))
    digests = {os.path.basename(r["path"]): r for r in exact.digested(found).collect()}
    assert sorted(digests) == sorted("abcdefg")
    assert digests["d"]["prehash"] and not digests["d"]["hash"] and digests["c"]["hash"] != digests["a"]["hash"] == digests["b"]["hash"]
    assert names(exact.exact_members(found)) == ["a", "b", "e", "g"]


def test_rescan_hits_the_cache(spark, tmp_path):
    tree(tmp_path, {**{f"{i}.{c}": f"pair {i:03} " * (2 + i % 3 * 600) for i in range(50) for c in "ab"}, "single": "x"})
    empty = spark.createDataFrame([], cache.SCHEMA)
    first = scan(spark, [str(tmp_path)], cache=empty, now=5)
    assert first.summary.first()["cache_prehash_hits"] == 0 and first.summary.first()["duplicate_groups"] == 50
    again = scan(spark, [str(tmp_path)], cache=materialize(first.cache, "cache"), now=6)
    s = again.summary.first()
    assert (s["cache_prehash_hits"], s["duplicate_groups"]) == (100, 50)
    assert s["cache_fullhash_hits"] == 100
    assert {r["created_at"] for r in again.cache.collect()} == {5}
    (tmp_path / "0.a").write_text("pair 999 pair 999 ")
    changed = scan(spark, [str(tmp_path)], cache=materialize(again.cache, "cache"), now=7)
    assert changed.summary.first()["cache_prehash_hits"] == 99 and changed.summary.first()["duplicate_groups"] == 49


def test_scan_wires_its_options(spark, tmp_path):
    tree(tmp_path, {"keep/a.txt": "same", "keep/b.log": "same", "more/c.txt": "same", "more/d.txt": "same", "more/skip.txt": "same", "keep/.gitignore": "*.log\n", "more/.x": "same"})
    roots = [str(tmp_path / "keep"), str(tmp_path / "more")]
    got = scan(spark, roots, ScanOptions(ignore=("skip*",), skip_hidden=True, named_roots={roots[1]: "new"}))
    rows = {os.path.basename(r["path"]): (r["is_reference"], r["group_name"]) for r in got.details().collect()}
    assert rows == {"a.txt": (True, None), "c.txt": (False, "new"), "d.txt": (False, "new")}
    assert {r["is_reference"] for r in scan(spark, roots[:1]).members.collect()} <= {False}
    assert {r["is_reference"] for r in scan(spark, roots[1:], ScanOptions(references=(roots[1],))).members.collect()} == {True}
    with pytest.raises(ScanError):
        scan(spark, [str(tmp_path / "nothing")])


def test_files_that_cannot_be_read(spark, tmp_path):
    tree(tmp_path, {"a": "same", "b": "same", "c": "same"})
    found, _ = walk(spark, [str(tmp_path)])
    found = materialize(found, "walked")
    (tmp_path / "c").unlink()
    got = scan_rows(found)
    assert names(got.members) == ["a", "b"] and names(got.errors) == ["c"]
    with pytest.raises(ScanError):
        scan_rows(found, ScanOptions(strict=True))
    with pytest.raises(ScanError):
        scan_rows(files(spark, [("/a", None, 0)]).withColumn("size", F.lit(3).cast("long")), ScanOptions(strict=True))


def test_walked_documents_and_images_are_compared(spark, tmp_path):
    rng = np.random.default_rng(4)
    ramp = (images.resized(rng.random((7, 7)), 64, 64) * 255).astype(np.uint8)[:, :, None].repeat(3, 2)
    noise = np.random.default_rng(1).integers(0, 255, (64, 64, 3)).astype(np.uint8)
    text = "one two three four five six seven eight nine ten " * 40
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    tree(tmp_path, {"a.png": images.as_png(ramp), "b.png": images.as_png(images.resized(ramp.astype(float), 48, 48).astype(np.uint8)), "c.png": images.as_png(noise), "broken.png": b"no image", "d.txt": text, "e.docx": docx.getvalue(), "f.txt": "nothing of the kind stands here, not a word of it", "bad.docx": b"PK"})
    for algorithm in ("phash", "ahash", "dhash"):
        got = scan(spark, [str(tmp_path)], ScanOptions(similar_images=True, similar_documents=True, image_algorithm=algorithm))
        groups = {}
        for r in got.members.collect():
            groups.setdefault(r["group_id"], []).append(os.path.basename(r["path"]))
        assert sorted(map(sorted, groups.values())) == [["a.png", "b.png"], ["d.txt", "e.docx"]]
    kept = scan(spark, [str(tmp_path)], ScanOptions(similar_images=True, similar_documents=True), spark.createDataFrame([], cache.SCHEMA), 3).cache
    known = {os.path.basename(r["path"]): r for r in kept.collect()}
    assert known["a.png"]["perceptual_hash"] is not None and known["a.png"]["algo"] == "phash" and known["d.txt"]["document_fingerprint"] is not None


def test_images_in_rows_with_content_are_compared(spark):
    ramp = (images.resized(np.random.default_rng(4).random((7, 7)), 64, 64) * 255).astype(np.uint8)[:, :, None].repeat(3, 2)
    small = images.as_png(images.resized(ramp.astype(float), 48, 48).astype(np.uint8))
    rows = [("/a.png", images.as_png(ramp)), ("/b.png", small), ("/c.png", b"no image"), ("/d.txt", small[:50])]
    df = spark.createDataFrame(rows, "path string, content binary").withColumns({"size": F.octet_length("content").cast("long"), "modified": F.timestamp_seconds(F.lit(0)), "group_name": F.lit(None).cast("string"), "mtime_ns": F.lit(1).cast("long")})
    got = scan_rows(df, ScanOptions(similar_images=True), cache=spark.createDataFrame([], cache.SCHEMA), now=1)
    assert names(got.members) == ["a.png", "b.png"]
    known = {r["path"]: r["perceptual_hash"] for r in got.cache.collect()}
    assert known["/a.png"] is not None and known["/c.png"] is None
    again = scan_rows(df, ScanOptions(similar_images=True), cache=materialize(got.cache, "cache"), now=2)
    assert names(again.members) == ["a.png", "b.png"] and {r["created_at"] for r in again.cache.collect()} == {1}


def chunked(*chunks):
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)) for kind, body in chunks)


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    pixels = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    flat, raw = pixels.reshape(5, 21).astype(int), b""
    for y in range(5):
        row = bytearray()
        for x in range(21):
            a, b, c = flat[y, x - 3] if x >= 3 else 0, flat[y - 1, x] if y else 0, flat[y - 1, x - 3] if y and x >= 3 else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((flat[y, x] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        raw += bytes([kind]) + bytes(row)
    head = struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)
    assert (images.decoded(chunked((b"IHDR", head), (b"IDAT", zlib.compress(raw)))) == pixels).all()


def test_other_image_kinds():
    one = struct.pack(">IIBBBBB", 9, 2, 1, 0, 0, 0, 0)
    bits = images.decoded(chunked((b"IHDR", one), (b"IDAT", zlib.compress(b"\0\xaa\x80\0\x55\0"))))
    assert bits[0, :, 0].tolist() == [255, 0] * 4 + [255] and bits[1, :3, 0].tolist() == [0, 255, 0]
    palette = struct.pack(">IIBBBBB", 2, 1, 8, 3, 0, 0, 0)
    assert images.decoded(chunked((b"IHDR", palette), (b"PLTE", bytes([1, 2, 3, 4, 5, 6])), (b"IDAT", zlib.compress(b"\0\1\0")))).tolist() == [[[4, 5, 6], [1, 2, 3]]]
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 0, 0, 0, 54, 40, 1, 2, 1, 24, 0, 0, 0, 0, 0, 0)
    assert images.decoded(head + bytes([1, 2, 3, 0, 4, 5, 6, 0])).tolist() == [[[6, 5, 4]], [[3, 2, 1]]]
    for bad in (b"", b"\x89PNG\r\n\x1a\n", b"BM", b"\xff\xd8\xff"):
        with pytest.raises(images.UnsupportedImage):
            images.decoded(bad)
    assert images.resized(np.array([[0.0, 2.0, 4.0]]), 1, 2).tolist() == [pytest.approx([2 / 3, 10 / 3])]
    uri = images.thumbnail(images.as_png(np.full((300, 200, 1), 7, np.uint8)), 50)
    small = images.decoded(base64.b64decode(uri.partition(",")[2]))
    assert small.shape == (50, 33, 1) and (small == 7).all()


def test_deleting_by_plan(spark, tmp_path):
    tree(tmp_path, {"a": "same", "b": "same", "c": "same", "d": "same"})
    got = scan(spark, [str(tmp_path)])
    plan = materialize(selection.deletion_plan(got.details()), "plan")
    (tmp_path / "d").write_text("now longer")
    rows = {os.path.basename(r["path"]): r for r in actions.delete_files(plan).collect()}
    assert sorted(rows) == ["b", "c", "d"] and rows["d"]["error"] and (tmp_path / "b").exists()
    (tmp_path / "trash").mkdir()
    done = materialize(actions.delete_files(plan, trash=str(tmp_path / "trash"), dry_run=False), "done").collect()
    assert sum(r["bytes_freed"] for r in done) == 8 and sorted(p.name for p in tmp_path.iterdir()) == ["a", "d", "trash"]
    with pytest.raises(actions.UnsafePlan):
        actions.delete_files(plan.withColumn("action", F.lit("delete")))


def test_a_deletion_that_runs_again(spark, tmp_path):
    """The first attempt of a task dies after half of its files; the report is whole all the same."""
    tree(tmp_path / "f", {f"{i}{c}": f"same {i}" for i in range(6) for c in "ab"})
    plan = materialize(selection.deletion_plan(scan(spark, [str(tmp_path / "f")]).details()), "plan")
    log = str(tmp_path / "log")
    lost = F.udf(lambda p: 1 // (os.path.basename(p) != "3b"))
    with pytest.raises(Exception, match="ZeroDivision"):
        actions.delete_files(plan, dry_run=False, log=log).coalesce(1).select(lost("path")).collect()
    assert len(os.listdir(tmp_path / "f")) < 12  # some are gone, and nobody was told
    done = actions.delete_files(plan, dry_run=False, log=log)
    for _ in range(2):  # and once more
        rows = done.collect()
        assert {(os.path.basename(r["path"]), r["bytes_freed"], r["error"]) for r in rows} == {(f"{i}b", 6, None) for i in range(6)}
    assert sorted(p.name for p in (tmp_path / "f").iterdir()) == [f"{i}a" for i in range(6)]


def test_intents_of_an_attempt_that_was_cut_off(tmp_path):
    first = actions._Intents(str(tmp_path))
    first.say("planned", "/a\n")
    first.say("done", "/a\n")
    first.say("planned", "/b")
    out = first._log("/b")[1]
    out.write('["planned", "/c')
    out.flush()
    second = actions._Intents(str(tmp_path))
    assert [second.said(p) for p in ("/a\n", "/b", "/c")] == ["done", "planned", None]


def test_hard_link_tracker(tmp_path):
    tree(tmp_path, {"a": "x", "b": "x"})
    os.link(tmp_path / "a", tmp_path / "c")
    seen = dedupe.HardlinkTracker()
    assert [seen.is_hardlink(os.stat(tmp_path / n)) for n in "abc"] == [False, False, True]
    assert seen.check(os.stat(tmp_path / "a")) and len(seen.seen) == 2
    seen.clear()
    assert not seen.check(os.stat(tmp_path / "a"))


def test_times_do_not_depend_on_the_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        one = spark.range(1).select(parse_date(F.lit("2024-03-10")).alias("d"), F.timestamp_seconds(F.lit(1710054000)).alias("t"))
        r = one.select(F.unix_seconds("d").alias("s"), formatting.rfc3339(F.col("t")).alias("utc"), formatting.local_time(F.col("t")).alias("here"), formatting.rfc3339(F.timestamp_seconds(F.lit(-1))).alias("old")).first()
        assert tuple(r) == (1710028800, "2024-03-10T07:00:00+00:00", "2024-03-10 03:00:00", "1969-12-31T23:59:59+00:00")
        f = files(spark, [("/a", "x", 0), ("/b", "x", 60)])
        assert names(predicates.passed(f, ScanOptions(newer_than="2024-01-01 00:30:00"))) == ["b"]
        assert names(predicates.passed(f, ScanOptions(older_than="2024-01-01"))) == ["a"]
        assert names(predicates.passed(f, ScanOptions(older_than="2023-12-31T19:00:00-05:00"))) == ["a"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_searches_that_one_engine_only_understands(spark):
    m = members(spark, [("g", "/(?P<n>x)", 1, 1, 1, False, None), ("h", "/xx", 1, 1, 1, False, "Grüße")])
    assert {r["group_id"] for r in views.search(m, "(?P<n>x)").collect()} == {"g"}
    assert {r["group_id"] for r in views.search(m, "(").collect()} == {"g"}
    assert {r["group_id"] for r in views.search(m, "X{2}|grü").collect()} == {"h"}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        def __getattr__(self, name):
            return lambda *a: self if name not in ("isLocal", "isEmpty", "get") else {"isLocal": False, "isEmpty": True, "get": None}[name]

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": lambda *a: None})()

    Session.sparkContext._jsc = Context()
    with pytest.raises(RuntimeError):
        tables.shared_dir(Session)


def test_tables_are_deleted_when_discarded(spark):
    t = materialize(spark.range(3), "three")
    path = t._kindred_path
    assert os.path.isdir(path.removeprefix("file:"))
    tables.discard(t, t)
    assert not os.path.exists(path.removeprefix("file:"))
    assert tables.size_of(spark.createDataFrame([("abc", 1), (None, 2)], "s string, n long")) == 2 * 32 + 3


def test_scan_unites_images_and_documents(spark):
    rows = [("/a.jpg", "1", 0), ("/b.png", "22", 0b1111), ("/c.gif", "333", -1), ("/d.jpg", "4444", None), ("/e.jpg", "same", 5 << 40), ("/f.jpg", "same", 5 << 40), ("/n.txt", "!!", 0), ("/o.txt", "?!!", 0)]
    df = spark.createDataFrame(rows, "path string, text string, hash long")
    f = from_table(df, F.col("path"), F.col("text"), F.timestamp_seconds(F.lit(0))).join(df.select("path", F.col("hash").alias("perceptual_hash")), "path")
    groups = lambda **o: {(r["is_similar"], tuple(sorted(r["p"]))) for r in find_duplicates(f, ScanOptions(similar_images=True, **o))[0].groupBy("group_id", "is_similar").agg(F.collect_list("path").alias("p")).collect()}
    copies, near = (False, ("/e.jpg", "/f.jpg")), (True, ("/a.jpg", "/b.png", "/e.jpg", "/f.jpg"))
    assert groups() == {copies, near}
    assert groups(image_algorithm="dhash", similar_documents=True) == {copies, (True, ("/a.jpg", "/e.jpg", "/f.jpg")), (True, ("/n.txt", "/o.txt"))}


def test_options_of_a_configuration(tmp_path):
    got = config.options({"min_size": "1.5KiB", "ignore": ["*.log"], "named_roots": ["a=/x", "b=/y"], "strict": True})
    assert got == ScanOptions(min_size=1536, ignore=("*.log",), named_roots={"/x": "a", "/y": "b"}, strict=True)
    with pytest.raises(ValueError, match="min_size"):
        config.options({"min_sise": 1})
    with pytest.raises(ValueError):
        config.options({"min_size": "big"})


def test_named_roots():
    assert parse_named_root("work-1=/a=b") == ("work-1", "/a=b")
    for bad in ("=x", "a=", "a b=x", "x"):
        with pytest.raises(ValueError):
            parse_named_root(bad)


def members(spark, rows):
    return spark.createDataFrame(rows, "group_id string, path string, size long, modified long, rank_in_group int, is_reference boolean, group_name string")


def test_selection_ties_and_references(spark):
    m = members(spark, [("g", "/r/1", 5, 9, 1, True, None), ("g", "/2", 5, 9, 2, False, None), ("g", "/3", 5, 1, 3, False, None)])
    paths_of = lambda df: sorted(r["path"] for r in df.collect())
    assert paths_of(selection.oldest(m)) == ["/3"]
    assert paths_of(selection.newest(m)) == ["/2"]
    assert paths_of(selection.duplicates(m)) == ["/2", "/3"]
    plan = {r["path"]: r["action"] for r in selection.deletion_plan(m).collect()}
    assert plan == {"/r/1": "keep", "/2": "delete", "/3": "delete"}
    assert selection.without_survivor(m, m.select("path")).count() == 1
    history = selection.History(m.select("path").limit(0))
    history.set(selection.duplicates(m))
    assert history.undo() and not history.undo()


def test_sinks(spark, tmp_path):
    m = members(spark, [("g", "/a'b", 5, 1, 1, False, None), ("g", "/<b>", 5, 2, 2, False, None)])
    one = spark.createDataFrame([(1,)], "duplicate_groups long")
    sinks.write_json(m, one, str(tmp_path / "o.json"), {}, "now")
    assert json.loads((tmp_path / "o.json").read_text())["duplicates"][0]["files"] == ["/a'b", "/<b>"]
    sinks.write_html(m, one, str(tmp_path / "o.html"))
    assert "&lt;b&gt;" in (tmp_path / "o.html").read_text()
    sinks.write_script(selection.deletion_plan(m), str(tmp_path / "o.sh"))
    assert "# keep '/a'\\''b'" in (tmp_path / "o.sh").read_text()
    full = {"total_files": 3, "total_size": 2048, "duplicate_files": 1, "duplicate_groups": 1, "reclaimable_space": 5, "cache_prehash_hits": 2}
    assert sinks.summary_lines(full)[2] == "  Total size:        2.00 KB" and sinks.summary_lines(full)[-1].endswith("2")
    assert json.loads(sinks.error_json("x", "no_duplicates")) == {"code": "RD002", "exit_code": 2, "message": "x", "interrupted": False}
    (tmp_path / "i.png").write_bytes(images.as_png(np.zeros((2, 2, 3), np.uint8)))
    shown = m.withColumn("path", F.when(F.col("path") == "/<b>", F.lit(str(tmp_path / "i.png"))).otherwise(F.col("path")))
    sinks.write_html(shown, one, str(tmp_path / "p.html"), phases={"Walking": "3ms"}, thumbnails=True)
    page = (tmp_path / "p.html").read_text()
    assert "data:image/png;base64," in page and "class=card" in page and "Walking" in page
    sinks.write_html(shown, one, str(tmp_path / "q.html"), thumbnails=True, embed=False)
    assert "file:///" in (tmp_path / "q.html").read_text()
    assert [sinks.exit_code(0, 0), sinks.exit_code(0, 1), sinks.exit_code(1, 1), sinks.exit_code(0, 0, True)] == [2, 0, 3, 130]


def test_cache_rules(spark):
    old = spark.createDataFrame([("/a", 1, 1, None, "p", "f", None, None, None, 5)], cache.SCHEMA)
    entry = lambda size, **more: spark.createDataFrame([("/a", size, 1, None, 9, *more.values())], "path string, size long, mtime_ns long, inode long, created_at long" + "".join(f", {k} string" for k in more))
    assert cache.upsert(old, entry(1, prehash="q"), "prehash").first()["fullhash"] is None
    assert cache.upsert(old, entry(1, fullhash="g"), "fullhash").first()["prehash"] == "p"
    assert cache.upsert(old, entry(2, fullhash="g"), "fullhash").first()["prehash"] is None


def test_config_layers(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text("min_size = 2\n[profile.big]\nmin_size = 3\n[scan]\na = 1\n")
    got = config.load({"min_size": 1, "scan": {"a": 0, "b": 0}}, str(p), "big", {"x": None}, {"KINDRED_SCAN__B": "7"})
    assert got == {"min_size": 3, "scan": {"a": 1, "b": 7}}
    assert config.suggestion("min_sise", ["max_size", "min_size"]) == "min_size"
    assert config.suggestion("zzzzzzzz", ["max_size"]) is None


def test_documents(tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = tmp_path / "d.docx"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>a</w:t></w:r><w:r><w:t>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    assert documents.extract("d.DOCX", p.read_bytes()) == "ab\nc\n"
    with pytest.raises(documents.UnsupportedFormat):
        documents.extract("x.xls", b"")


def test_previews():
    assert preview.preview("a.png", b"GIF89a\x02\0\x03\0") == "GIF 2 x 3" and preview.preview("a.txt", b"a\0b") == "a\0b" and preview.preview("x", b"a\0b").startswith("00000000")
    assert preview.is_binary(b"a\0b") and not preview.is_binary("é\n".encode())
    assert preview.image_size(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (3).to_bytes(4) + (4).to_bytes(4)) == ("PNG", 3, 4)
    assert preview.hex_dump(b"AB\0").startswith("00000000  41 42 00") and preview.hex_dump(b"AB\0").endswith("|AB.|")


def test_formats(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert [get(format_size(F.lit(n))) for n in (1536, 1152, 1162, 1023)] == ["1.50 KB", "1.12 KB", "1.13 KB", "1023 B"]
    assert [get(format_duration(F.lit(x))) for x in (12, 3456, 62_000, 3_723_000)] == ["12ms", "3.456s", "1m 2s", "1h 2m 3s"]
    assert get(posix_quoted(F.lit("a'b"))) == "'a'\\''b'"
    assert get(truncated_path(F.lit("/a/long/path"), 8)) == ".../path"[-8:]
    assert get(parse_date(F.lit("nope"))) is None
    assert [get(progress.remaining_seconds(F.lit(x), F.lit(2.0))) for x in (10, 10**9)] == [5.0, None]
