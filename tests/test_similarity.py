"""Hamming joins at larger distances, the greedy walk in blocks, the similarity index."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions.hashing import hamming
from kindred.operators import greedy as walk
from kindred.operators import exact, index, probing, ranking, similar
from kindred.operators.index import SimilarityIndex
from kindred.queries import ORACLE_SQL, QUERIES
from tests.oracle import agrees

ALL = 2**64 - 1
SF = "/root/testdata/sf0.001"


def signed(v):
    return v - 2**64 if v >= 2**63 else v


def near_values(seed, bases, copies, flips, bits=64):
    """Distinct fingerprints around some others, so that distances of all sizes are there."""
    rng = random.Random(seed)
    out = set()
    for _ in range(bases):
        b = rng.getrandbits(64)
        for _ in range(copies):
            v = b
            for _ in range(rng.randrange(flips)):
                v ^= 1 << rng.randrange(bits)
            out.add(v & ALL)
    return sorted(map(signed, out))


def brute_pairs(values, most):
    v = np.array(values, np.int64).view(np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :])
    a, b = np.nonzero(near <= most)
    return {(values[i], values[j], int(near[i, j])) for i, j in zip(a, b) if values[i] < values[j]}


def found_pairs(spark, values, most, many=None):
    rows = [tuple(r) for r in similar.hamming_pairs(spark.createDataFrame([(v,) for v in values], "hash long"), most, many).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


# What is told about the number of values decides bands and regions, never the pairs.
@pytest.mark.parametrize("most,many", [(4, None), (4, 10**7), (7, None), (7, 10**6), (10, None), (10, 10**4), (10, 10**6), (10, 10**9), (14, None)])
def test_probed_pairs_are_complete(spark, most, many):
    values = near_values(most, 25, 9, most + 4)
    assert found_pairs(spark, values, most, many) == brute_pairs(values, most) != set()


@pytest.mark.parametrize("most", [1, 2, 3])
def test_rows_of_keys_are_dealt_by_their_number(spark, monkeypatch, most):
    """Tasks do not grow with the input: parts are not merged up to some bytes."""
    monkeypatch.setattr(similar, "KEY_ROWS", 100, raising=False)
    monkeypatch.setattr(similar, "CHUNK", 50, raising=False)
    values = near_values(most, 40, 9, most + 3)
    df = similar.hamming_pairs(spark.createDataFrame([(v,) for v in values], "hash long"), most)
    assert df.rdd.getNumPartitions() >= len(values) * (most + 1) // 100 > 4
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_pairs(values, most) != set()


def written_parts(spark, monkeypatch, of):
    """Result of an operator, and the partitions in which it writes its pairs."""
    monkeypatch.setattr(similar, "KEY_ROWS", 100, raising=False)
    parts, write = [], similar.materialize
    monkeypatch.setattr(similar, "materialize", lambda df, tag, *a: (tag == "hamming_pairs" and parts.append(df.rdd.getNumPartitions()), write(df, tag, *a))[1])
    rows = [(f"/{i:04}", v) for i, v in enumerate(near_values(5, 40, 9, 6))]
    return rows, of(spark.createDataFrame(rows, "path string, hash long"), 3).collect(), parts


def test_pairs_of_the_walk_are_dealt_by_their_number(spark, monkeypatch):
    rows, found, parts = written_parts(spark, monkeypatch, similar.leader_groups)
    assert len(parts) == 1 and parts[0] >= len(rows) * 4 // 100
    assert {r["path"]: r["leader"] for r in found} == brute_leaders(rows, 3, 2)


@pytest.mark.parametrize("name", ["similar_documents", "similar_minus_exact", "kind_filter"])
def test_values_of_a_query_are_dealt_before_they_become_keys(spark, monkeypatch, name):
    """No task makes the keys of all values, however short these are."""
    monkeypatch.setattr(similar, "KEY_ROWS", 100)
    parts, hot_keys = [], similar._hot_keys
    monkeypatch.setattr(similar, "_hot_keys", lambda distinct, *a: parts.append((distinct.count(), distinct.rdd.getNumPartitions())) or hot_keys(distinct, *a))
    found = QUERIES[name](spark, SF)
    assert [n >= values * 4 // 100 > 4 for values, n in parts] == [True]
    agrees(found, ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", ["kind_filter", "similar_minus_exact"])
@pytest.mark.parametrize("module,tag", [(exact, "groups"), (similar, "nodes")])
def test_groups_of_a_query_are_counted_by_their_number(spark, monkeypatch, name, module, tag):
    """No task counts all hashes, however short these are."""
    monkeypatch.setattr(ranking, "TALLY_ROWS", 20, raising=False)
    parts, write = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, t, *a: (t == tag and parts.append(df.rdd.getNumPartitions()), write(df, t, *a))[1])
    found = QUERIES[name](spark, SF)
    assert len(parts) == 1 and parts[0] >= 190 // 20
    agrees(found, ORACLE_SQL[name], SF)


def test_rows_of_a_frequent_hash_are_counted_in_shares(spark, monkeypatch):
    monkeypatch.setattr(ranking, "TALLY_ROWS", 50)
    rows = [(f"/{i:04}", i % 7 if i % 3 else 0) for i in range(1000)] + [("/null", None)]
    df = spark.createDataFrame(rows, "path string, hash long")
    want = {h: (min(p for p, o in rows if o == h), sum(o == h for _, o in rows)) for h in {h for _, h in rows}}
    dealt, repartition = [], type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: dealt.append(repartition(self, *a)) or dealt[-1])
    got = ranking.tallied(df, "hash", len(rows), "first")
    assert {r["hash"]: (r["first"], r["n"]) for r in got.collect()} == want
    assert {r["hash"]: r["n"] for r in ranking.tallied(df, "hash", len(rows)).collect()} == {h: n for h, (_, n) in want.items()}
    assert ranking.tallied(df, "hash", 10, "first").dtypes == got.dtypes
    of_task = dealt[0].groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert of_task < 300 < want[0][1]


def test_links_find_their_pairs_once(spark, monkeypatch):
    rows, found, parts = written_parts(spark, monkeypatch, similar.file_links)
    assert len(parts) == 1 and parts[0] >= len(rows) * 4 // 100
    near = [h for a, b, _ in brute_pairs([h for _, h in rows], 3) for h in (a, b)]
    assert {r["path"]: (r["copies"], r["near_classes"], r["near_files"]) for r in found} == {p: (0, near.count(h), near.count(h)) for p, h in rows}


@pytest.mark.parametrize("most,many", [(1, None), (3, None), (3, 10**4)])
def test_keys_of_many_fingerprints_are_cut_into_blocks(spark, monkeypatch, most, many):
    monkeypatch.setattr(similar, "HOT", 12)
    values = near_values(most, 6, 60, 12, bits=14)
    told = []
    hot_keys = similar._hot_keys
    monkeypatch.setattr(similar, "_hot_keys", lambda *a: told.append(hot_keys(*a)) or told[-1])
    assert found_pairs(spark, values, most, many) == brute_pairs(values, most) != set()
    assert max(s for _, s in told[0]) > 2
    assert similar._hot_keys(spark.createDataFrame([], "hash long"), [(0,)], [0, 64], 10**6) == []


@pytest.mark.parametrize("skew", ["low", "high", "one"])
def test_pairs_of_skewed_bits(spark, skew):
    """Fingerprints that differ in a part of their bits only."""
    rng = random.Random(2)
    part = {"low": (1 << 24) - 1, "high": ALL ^ ((1 << 44) - 1), "one": ALL}[skew]
    values = sorted({signed((0x5A5A << 20 ^ rng.getrandbits(64)) & part) for _ in range(150)})
    assert found_pairs(spark, values, 10) == brute_pairs(values, 10)


def test_hot_regions_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(probing, "STORED", 20)
    monkeypatch.setattr(probing, "PROBES", 35)
    monkeypatch.setattr(probing, "CHUNK", 64)
    values = near_values(9, 6, 40, 12, bits=20)
    assert found_pairs(spark, values, 10, 200) == brute_pairs(values, 10)
    bands = probing.dealt(200, 10, np.array(values, np.int64))
    counts = {}
    for i, b in enumerate(bands):
        for v in values:
            at = i, ((v & ALL) >> b.start & (1 << b.width) - 1) >> (b.width - b.region)
            counts[at] = counts.get(at, 0) + 1
    assert probing._blocks(counts, bands)


@pytest.mark.parametrize("values", [2, 10**3, 10**6, 10**8])
def test_bands_hold_the_pigeonhole_and_few_keys(values):
    rng = np.random.default_rng(0)
    random_values = rng.integers(-(2**63), 2**63 - 1, min(values, 5000))
    bands = probing.dealt(values, 10, random_values)
    assert sum(b.radius + 1 for b in bands) == 11
    assert all(b.start + b.width <= c.start for b, c in zip(bands, bands[1:]))
    assert probing.keys_of(bands) < (50 if values <= 10**6 else 160)


def test_radii_follow_the_skew():
    rng = np.random.default_rng(1)
    flat = rng.integers(0, 2**63 - 1, 5000) & ~np.int64((1 << 22) - 1)  # the lowest band tells nothing
    bands = probing.dealt(10**6, 10, flat)
    assert sum(b.radius + 1 for b in bands) == 11
    even = probing.dealt(10**6, 10, rng.integers(-(2**63), 2**63 - 1, 5000))
    lowest = lambda found: sum((b.radius + 1) * max(0, min(22, b.start + b.width) - b.start) / b.width for b in found)
    assert lowest(bands) < lowest(even)


def test_empty_and_single(spark):
    for values in ([], [5]):
        assert found_pairs(spark, values, 10) == set()


def test_flips():
    assert sorted(probing.flips(5, 2)) == sorted(v for v in range(32) if v.bit_count() <= 2)
    assert len(probing.flips(22, 3)) == probing.around(22, 3)


# The walk.


def brute_leaders(rows, most, least):
    """File by file, as a scan walks them."""
    left, out = dict(sorted(rows)), {}
    for path, h in sorted(rows):
        if path in left:
            near = [p for p, g in left.items() if ((g ^ h) & ALL).bit_count() <= most]
            if len(near) >= least:
                for p in near:
                    out[p] = path
                    del left[p]
    return out


@pytest.mark.parametrize("least", [1, 2, 3, 5])
@pytest.mark.parametrize("block", [10**6, 40, 6])
def test_leaders_are_what_a_walk_finds(spark, monkeypatch, least, block):
    """At 40 links a block there are many blocks, at 6 most nodes are hubs too."""
    monkeypatch.setattr(walk, "BLOCK", block)
    rng = random.Random(least)
    base = [rng.getrandbits(63) for _ in range(5)]
    rows = []
    for i in range(90):
        h = rng.choice(base)
        for _ in range(rng.randrange(4)):
            h ^= 1 << rng.randrange(12)
        rows.append((f"/{rng.randrange(10**6):06}-{i}", h))
    rows += [(f"/lone{i}", rng.getrandbits(63)) for i in range(5)]
    df = spark.createDataFrame([*rows, ("/none", None)], "path string, hash long")
    got = {r["path"]: r["leader"] for r in similar.leader_groups(df, 3, least).collect()}
    assert got == brute_leaders(rows, 3, least)


def brute_walk(nodes, pairs, least):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    count, leader = {i: n for i, _, n in nodes}, {}
    for i, _, _ in sorted(nodes, key=lambda x: (x[1], x[0])):
        if i in near and i not in leader:
            free = [k for k in {i, *near[i]} if k not in leader]
            if sum(count[k] for k in free) >= least:
                leader.update(dict.fromkeys(free, i))
    return leader


def walked(spark, nodes, pairs, least, rounds=None):
    df = walk.greedy(spark.createDataFrame(nodes, "id long, first string, n long"), spark.createDataFrame(pairs, "a long, b long"), least, rounds)
    return {r["id"]: r["leader"] for r in df.collect()}


@pytest.mark.parametrize("least", [2, 3])
def test_a_long_chain_takes_few_rounds(spark, monkeypatch, least):
    """10^5 nodes, each linked with the next in the order, are one chain of decisions."""
    monkeypatch.setattr(walk, "BLOCK", 60_000)
    n = 100_000
    nodes = [(i, f"{i:07}", 1) for i in range(n)]
    pairs = [(i, i + 1) for i in range(n - 1)]
    rounds = []
    got = walked(spark, nodes, pairs, least, rounds)
    assert got == brute_walk(nodes, pairs, least)
    assert len(rounds) <= 6 < 40 and sorted(rounds, reverse=True) == rounds


@pytest.mark.parametrize("block", [30, 10**6])
def test_random_graphs(spark, monkeypatch, block):
    monkeypatch.setattr(walk, "BLOCK", block)
    rng = random.Random(block)
    nodes = [(i, f"{rng.randrange(40):03}", rng.randrange(1, 4)) for i in range(120)]  # tied first paths
    pairs = sorted({tuple(sorted(rng.sample(range(120), 2))) for _ in range(200)} | {(7, i) for i in range(8, 60)})
    for least in (2, 6):
        assert walked(spark, nodes, pairs, least) == brute_walk(nodes, pairs, least)


def test_no_links(spark):
    assert walked(spark, [(1, "a", 1)], [], 2) == {}


# The index.


def indexed(spark, tmp_path, values, centres=8):
    df = spark.createDataFrame([(f"f{i}", v, i % 3) for i, v in enumerate(values)], "name string, hash long, extra int")
    return df, SimilarityIndex.build(df, str(tmp_path / "index"), centres)


@pytest.mark.parametrize("radius", [0, 3, 10, 64])
def test_index_finds_all_within_the_radius(spark, tmp_path, radius):
    values = near_values(4, 12, 10, 8)
    indexed(spark, tmp_path, [*values, None, values[0]])
    held = SimilarityIndex.open(spark, str(tmp_path / "index"))
    asked = [values[0], values[50], 12345, values[7] ^ 1]
    q = spark.createDataFrame([(i, v) for i, v in enumerate([*asked, None])], "id int, hash long")
    got = sorted((r["query_id"], r["name"], r["distance"]) for r in held.search(q, radius).collect())
    want = sorted((i, f"f{j}", ((a ^ v) & ALL).bit_count()) for i, a in enumerate(asked) for j, v in enumerate([*values, None, values[0]]) if v is not None and ((a ^ v) & ALL).bit_count() <= radius)
    assert got == want


def test_index_reads_few_folders(spark, tmp_path):
    """Only leaves that the triangle inequality leaves over are opened, and the scan is told so."""
    values = near_values(6, 20, 30, 5)
    df, held = indexed(spark, tmp_path, values, 16)
    leaves = {r["f"] for r in held.rows().select(F.regexp_extract(F.input_file_name(), "(_centre=.*/_ring=[^/]*)/", 1).alias("f")).distinct().collect()}
    q = spark.createDataFrame([(values[0],)], "hash long")
    asked = {f"_centre={r['_centre']}/_ring={r['_ring']}" for r in held.leaves_of(q.withColumnRenamed("hash", "_query"), 3).collect()}
    found = held.search(q, 3)
    plan = found._jdf.queryExecution().executedPlan()
    assert "PartitionFilters" in plan.toString() and "_centre" in plan.toString().split("PartitionFilters", 1)[1]
    assert len(found.collect()) == sum(((values[0] ^ v) & ALL).bit_count() <= 3 for v in values)
    assert len(asked & leaves) * 4 < len(leaves)
    assert [n for n, columns in _scans(found) if "_apart" in columns] == [len(asked & leaves)]


def _scans(df):
    """(partitions read, columns) of the file scans of a plan that ran."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec":
            out.append((node.selectedPartitions().partitionCount(), node.schema().simpleString()))
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_index_takes_more_rows(spark, tmp_path):
    values = near_values(8, 4, 5, 4)
    df, held = indexed(spark, tmp_path, values, 3)
    held.add(spark.createDataFrame([("new", values[0], 9), ("none", None, 9)], df.schema))
    q = spark.createDataFrame([(values[0],)], "hash long")
    assert sorted(r["name"] for r in held.search(q, 0).collect()) == ["f0", "new"]
    with pytest.raises(Exception, match="exist"):
        SimilarityIndex.build(df, held.path)
    with pytest.raises(ValueError, match="_ring"):
        SimilarityIndex.build(df.withColumn("_ring", F.lit(1)), str(tmp_path / "other"))


def test_index_of_nothing(spark, tmp_path):
    df, held = indexed(spark, tmp_path, [])
    assert held.search(spark.createDataFrame([(1,)], "hash long"), 64).count() == 0


def test_centres_lie_apart(spark):
    rows = spark.createDataFrame([(v,) for v in near_values(1, 8, 20, 3)], "hash long")
    chosen = index.chosen_centres(rows, 8)
    assert len(set(chosen)) == 8 and min(((a ^ b) & ALL).bit_count() for a in chosen for b in chosen if a != b) > 6
    assert rows.filter(hamming(F.col("hash"), F.lit(chosen[0])) == 0).count() == 1
