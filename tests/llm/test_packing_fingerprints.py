import hashlib
import random
import struct
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import orderhash, packing
from tests.llm.awkward import ROWS, documents

SF = "/root/testdata/sf0.001"


def check_places(rows, capacity=4096):
    spans = defaultdict(list)
    for r in rows:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spans)


def pieces_of(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    out = []
    for doc, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            out.append((doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=str)


def test_packing_is_whole_and_tight(spark):
    rows = packing.op7_packing(spark, SF).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == pieces_of(docs)
    used = check_places(rows)
    assert used <= 1.03 * sum(r["length"] for r in rows) / 4096 + 1


def test_packing_awkward_rows(spark):
    out = packing.place(packing.cut(documents(spark), with_ids=True))
    rows = out.collect()
    check_places(rows)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == pieces_of([(r[0], r[1]) for r in ROWS])
    joined = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(out).collect()}
    for r in rows:
        assert joined[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    assert packing.place(packing.cut(documents(spark, []))).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 60), max_size=30))
def test_plans_place_every_piece_once(histogram):
    blocks = packing.pack(histogram, 100, 8)
    got = defaultdict(int)
    for times, items in blocks:
        assert times > 0 and sum(n * c for n, c in items) <= 100
        for n, c in items:
            got[n] += times * c
    assert got == histogram
    seen = defaultdict(int)
    for length, first, *_ in packing.places(blocks).tolist():
        assert first == seen[length] or first > seen[length] - 1
        seen[length] = max(seen[length], first)


def test_plans_are_near_the_least():
    rng = random.Random(2)
    histogram = defaultdict(int)
    for _ in range(5000):
        histogram[min(4096, int(rng.lognormvariate(6, 1)) + 1)] += 1
    blocks = packing.pack(dict(histogram))
    least = -(-sum(n * c for n, c in histogram.items()) // 4096)
    assert sum(t for t, _ in blocks) <= 1.02 * least + 1


@pytest.mark.parametrize("sf,factor,share,over", [("sf0.1", 1, 0.95, 1.005), ("sf0.01", 1, 0.8, 1.03), ("sf0.01", 1000, 0.99, 1.01)])
def test_large_pieces_stand_in_configurations(sf, factor, share, over):
    """Pieces of over 1024 tokens are packed by few kinds of configurations, of three and more
    pieces too, and sequences are few. The bounds do not follow the operator's parameters."""
    import duckdb

    enc, histogram = packing.encoder(packing.tokenizer_path()), defaultdict(int)
    for (text,) in duckdb.sql(f"SELECT text FROM '/root/testdata/{sf}/documents.parquet'").fetchall():
        n = len(enc.texts([text or ""])[0]) // 4 + 1
        histogram[4096] += n // 4096
        histogram[n % 4096] += n % 4096 > 0
    histogram.pop(0, None)
    many = {n: c * factor for n, c in histogram.items() if c}
    large = {n: c for n, c in many.items() if 1024 < n < 4096}
    began, placed, most = time.time(), defaultdict(int), 0
    for times, items in packing.configured(many):
        most = max(most, sum(items.values()))
        for n, c in items.items():
            placed[n] += times * c
    total = sum(t for t, _ in packing.pack(many))
    assert time.time() - began < 10
    assert all(c <= large[n] for n, c in placed.items())
    assert sum(placed.values()) >= share * sum(large.values()) and most >= 3
    assert total <= over * -(-sum(n * c for n, c in many.items()) // 4096) + 1
    sizes, runs = packing.grouped(sorted(large.items(), reverse=True), packing.GROUPS)
    assert len(sizes) <= 48 and len(packing.configurations(sizes, [sum(c for _, c in r) for r in runs], 4096)) <= 48


def test_hot_lengths_are_ranked_in_cells(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 7)
    rows = [(i, " ".join(["word"] * (i % 3 + 1)), "en", "a") for i in range(100)]
    check_places(packing.place(packing.cut(documents(spark, rows)), capacity=16).collect(), 16)


def test_knapsack_is_exact():
    rng = random.Random(4)
    for _ in range(20):
        sizes, worth = [rng.randrange(20, 90) for _ in range(4)], [rng.random() for _ in range(4)]
        best = max(
            sum(c * w for c, w in zip(n, worth))
            for n in np.ndindex(6, 6, 6, 6)
            if sum(n) <= 5 and sum(c * s for c, s in zip(n, sizes)) <= 100
        )
        value, counts = packing.knapsack(np.array(sizes), np.array(worth), 100, 5)
        assert value == pytest.approx(best) and sum(c * s for c, s in zip(counts, sizes)) <= 100


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_encoder_is_the_tokenizer(texts):
    enc = packing.encoder(packing.tokenizer_path())
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.texts(texts)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def spark_hash(*values):
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), h)
    return h - 2**64 if h >= 2**63 else h


def spark_hash_int(a, b):
    return xxhash.xxh64_intdigest(struct.pack("<i", b), xxhash.xxh64_intdigest(struct.pack("<q", a), 42))


def cell_hash(entry, cell):
    return xxhash.xxh64_intdigest(struct.pack("<i", cell), xxhash.xxh64_intdigest(struct.pack("<i", entry), 42)) >> 24


def brute_entries(text):
    """For each entry the two least of all runs in its order."""
    words = [spark_hash(w) for w in (text or "").encode().split()]
    runs = sorted(((spark_hash(*words[i : i + 3]) % 2**64) >> 32, i) for i in range(len(words)))
    seen, numbered = defaultdict(int), []
    for h, i in runs:
        numbered.append((spark_hash_int(h, seen[h]) >> 32, i))
        seen[h] += 1
    out = []
    for e in range(64 if numbered else 0):
        first = sorted(numbered, key=lambda x: (0 if x[0] >> 26 == e else 1 + cell_hash(e, x[0] >> 26), x))[:2]
        h = spark_hash(*[v for v, _ in sorted(first, key=lambda x: x[1])]) % 2**64
        out.append(e << 32 | h >> 32)
    return out


def brute_fingerprints(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = []
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, new, nxt = map(brute_entries, (text, edited, after))
        like = lambda a, b: 1.0 if not a and not b else (len(set(a) & set(b)) / 64) ** 0.5
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x % 2**32:08X}" for x in own), "".join(f"{x % 2**32:08X}" for x in new), pytest.approx(like(own, new)), pytest.approx(like(own, nxt))))
    return out


@pytest.mark.parametrize("bucket", [1 << 17, 7])
def test_fingerprints_are_what_brute_force_gives(spark, monkeypatch, bucket):
    monkeypatch.setattr(orderhash, "BUCKET_ROWS", bucket)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in orderhash.op9_order_minhash(spark, SF).orderBy("doc_id", ascending=False).collect()]
    assert got == brute_fingerprints(rows)


def test_fingerprints_of_repeats_and_short_texts(spark):
    rows = [(1, "a " * 5000), (2, "b c " * 3000 + "d"), (3, None), (4, "one"), (5, "two words"), (6, "x y z"), (7, "a " * 5001), (8, "é" * 50_000)]
    got = [tuple(r) for r in orderhash.fingerprints(documents(spark, [(i, t, "en", "a") for i, t in rows])).orderBy("doc_id", ascending=False).collect()]
    assert got == brute_fingerprints(rows)


def test_fingerprints_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(orderhash, "BUCKET_ROWS", 2)
    got = orderhash.fingerprints(documents(spark)).collect()
    assert len(got) == len(ROWS)
    by_text = defaultdict(set)
    for r, (_, text, *_x) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["n_chars"])), sorted(ROWS, key=lambda r: (r[0] is None, r[0], len(r[1] or "")))):
        by_text[text or ""].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert orderhash.fingerprints(documents(spark, [])).count() == 0
    one = orderhash.fingerprints(documents(spark, ROWS[:1])).first()
    assert one["near_next"] == 1.0


def test_next_rows_of_a_key_that_many_share(spark, monkeypatch):
    monkeypatch.setattr(orderhash, "BUCKET_ROWS", 5)
    rows = [(None if i % 3 == 0 else 4 if i % 3 == 1 else i, f"t{i % 40}") for i in range(120)]
    df = spark.createDataFrame(rows, "k long, t string")
    got = orderhash.with_next(df, "k", ["k", "t"], "t").collect()
    order = lambda r: (r[0] is None, -(r[0] or 0), spark_hash(r[1].encode()), r[1])
    want = sorted(rows, key=order)
    assert sorted((order((r["k"], r["t"])), order((r["next_k"], r["next_t"]))) for r in got) == sorted((order(a), order(b)) for a, b in zip(want, want[1:] + want[:1]))


@pytest.mark.parametrize("words,most", [(6, 0.6), (20, 0.75), (60, 0.8)])
def test_order_counts_in_short_texts(spark, words, most):
    """Halves that change places leave nearly all runs, but in another order."""
    rows = []
    for i in range(0, 40, 2):
        w = [f"w{i}x{j}" for j in range(words)]
        rows += [(i + 1, " ".join(w), "en", "a"), (i, " ".join(w[words // 2 :] + w[: words // 2]), "en", "a")]
    near = [r["near_next"] for r in orderhash.fingerprints(documents(spark, rows)).filter("doc_id % 2 = 1").collect()]
    assert (words == 6) == (np.mean(near) == 0) and np.mean(near) < most


def test_moved_text_costs_likeness(spark):
    words = [f"w{i}" for i in range(900)]
    rng = random.Random(3)
    blocks = [words[i : i + 60] for i in range(0, 900, 60)]
    rng.shuffle(blocks)
    rows = [(2, " ".join(words), "en", "a"), (1, " ".join(w for b in blocks for w in b), "en", "a")]
    near = orderhash.fingerprints(documents(spark, rows)).filter("doc_id = 2").first()["near_next"]
    assert 0.3 < near < 0.95  # a plain MinHash would see nearly the same runs
