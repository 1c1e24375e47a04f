import math
import random

import numpy as np
import pytest

from kindred.llm import nearjoin, pivots
from tests.llm.awkward import ROWS, documents
from tests.oracle import agrees

SF = "/root/testdata/sf0.001"


def test_near_join_agrees_with_sql(spark):
    agrees(nearjoin.op4_near_join(spark, SF), nearjoin.OP4_SQL, SF)


def test_search_agrees_with_sql(spark):
    agrees(pivots.op3_pivots(spark, SF), pivots.OP3_SQL, SF)


def runs_of(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(links, text links, group) by comparing all texts."""
    texts = [tuple((t or "").encode().split()) for _, t in rows]
    sets = [runs_of(t) for _, t in rows]
    n = len(rows)
    near = [[j for j in range(n) if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in range(n)]
    group = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in near[i]:
                group[i] = group[j] = min(group[i], group[j])
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[group[i]] = min(low.get(group[i], d), d)
    return [(rows[i][0], low.get(group[i], rows[i][0]), len(near[i]), len({texts[j] for j in near[i]} - {texts[i]})) for i in range(n)]


def near_rows(seed=3, families=12, size=9):
    rng, out = random.Random(seed), []
    for _ in range(families):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 7, 60, 200]))]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(9)}"
            out.append(" ".join(t))
    return list(enumerate(out))


@pytest.mark.parametrize("blocks", [(2048, 768, 16 << 20), (3, 2, 16 << 20), (5, 768, 700)])
def test_near_join_is_whole(spark, monkeypatch, blocks):
    monkeypatch.setattr(nearjoin, "BUCKET_BLOCK", blocks[0])
    monkeypatch.setattr(nearjoin, "TEXT_BLOCK", blocks[1])
    monkeypatch.setattr(nearjoin, "TEXT_BYTES", blocks[2])
    if blocks[0] == 3:
        monkeypatch.setattr(nearjoin, "bounded", lambda df: df)
    rows = near_rows()
    got = nearjoin.near_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"], r["links"], r["text_links"]) for r in got) == sorted(brute(rows))
    assert sum(r["stays"] for r in got) == len({r["class_id"] for r in got})


def test_near_join_awkward_rows(spark):
    got = nearjoin.near_links(documents(spark)).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["class_id"], r["links"], r["text_links"]) for r in got), key=key) == sorted(brute([(r[0], r[1]) for r in ROWS]), key=key)
    assert nearjoin.near_links(documents(spark, [])).count() == 0
    kept = nearjoin.distinct_documents(documents(spark))
    assert kept.columns == documents(spark).columns
    assert kept.count() == len(ROWS) - 3


def test_near_copies_without_a_number(spark, monkeypatch):
    """Rows that share a null key, or one key, are told apart by their own numbers."""
    read = []
    real = nearjoin.shared_runs
    monkeypatch.setattr(nearjoin, "bounded", lambda df: read.append(df.count()) or df)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(30)]
    rows = [(None, t) for t in texts] + [(7, t + " end") for t in texts] + [(None, texts[0])] * 5
    got = nearjoin.near_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert read[0] == 60 and real is nearjoin.shared_runs
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["class_id"], r["links"], r["text_links"]) for r in got), key=key) == sorted(brute(rows), key=key)


def test_hot_bucket_needs_few_rows(spark, monkeypatch):
    """A group of near copies over many blocks is dealt out once a band, not once a block."""
    monkeypatch.setattr(nearjoin, "BUCKET_BLOCK", 20)
    dealt, real = [], nearjoin._dealt


    def counted(*a):
        out = real(*a)
        dealt.append(out.count())
        return out

    monkeypatch.setattr(nearjoin, "_dealt", counted)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: i % 200], f"x{i}", *base[i % 200 + 1 :]])) for i in range(400)]
    got = nearjoin.near_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0} and {r["links"] for r in got} == {399}
    assert dealt[0] + dealt[1] <= 2 * 400 * nearjoin.BANDS


def test_equal_buckets_are_compared_once(spark):
    rows = [(u, b, 100 * b + g, 3) for b in range(4) for g, us in enumerate([(1, 2, 3), (4, 5, 6) if b % 2 else (4, 5, 7)]) for u in us]
    kept = nearjoin._once_each(spark.createDataFrame(rows, "uid long, band int, bucket long, size long")).collect()
    assert {r["bucket"] for r in kept} == {0, 1, 101} and len(kept) == 9


def test_pruning_keeps_what_can_reach_the_threshold():
    least = nearjoin.least_matches(0.8, 1e-6)
    assert list(least) == sorted(least) and 0 < least[0] < 0.8 * 32 and least[-1] > 0.5 * 160


def brute_top(rows, queries, k):
    """Whole numbers by Python; every row counts, and every query row asks."""
    scaled = [(i, [math.floor(x * 1024) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x * 1024) for x in v)]
    out = []
    for q, own in scaled:
        if q in queries:
            long = lambda s: max(-(2**63), min(2**63 - 1, s))
            best = sorted((-long(sum(a * b for a, b in zip(own, v))), i) for i, v in scaled if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_search_awkward_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.5, 0.25, 0.1, 2.0]) for _ in range(4)]) for i in range(300)]
    rows += [(300, None), (400, [1.0, None, 0.0, 0.0]), (500, [float("nan")] * 4), (600, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (700, []), (100, rows[100][1]), (5, rows[5][1]), (800, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS id", "'y' AS v", "'z' AS score")
    got = sorted(tuple(r) for r in pivots.top_products(df, df.filter("vec_id % 100 = 0")).collect())
    assert got == brute_top(rows, set(range(0, 900, 100)), 10)
    assert pivots.top_products(df.limit(0), df.limit(0)).count() == 0


def test_search_in_blocks_and_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(pivots, "QUERY_BLOCK", 4)
    rows = [(i, [float((i * 37) % 101) * 1e4, float(i % 7), -3.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in pivots.top_products(df, df.filter("vec_id % 5 = 0"), k=3).collect())
    assert got == brute_top(rows, set(range(0, 60, 5)), 3)


@pytest.mark.parametrize("big", [1e9, 1e16, 1e38, 1e300])
def test_search_of_numbers_beyond_a_long(spark, big):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 1.5, -2.25, big, -big]), rng.choice([0.0, 1.0, big]), 0.5]) for i in range(40)] + [(50, [1.7e308, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in pivots.top_products(df, df.filter("vec_id % 5 = 0"), k=4).collect())
    assert got == brute_top(rows, set(range(0, 60, 5)), 4)


def test_search_agrees_with_sql_on_repeated_rows(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").limit(150)
    twice = rows.unionByName(rows.filter("vec_id % 50 < 3")).unionByName(rows.filter("vec_id = 100"))
    pdf = twice.toPandas()
    pdf.to_parquet(tmp_path / "embeddings.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = sorted(tuple(r) for r in pivots.op3_pivots(spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(pivots.OP3_SQL).fetchall()) and len(got) == 10 * (2 + 3)


def test_bounds_leave_candidates_out():
    rng = np.random.default_rng(5)
    centres = rng.integers(-900, 900, (40, 8))
    v = (centres[rng.integers(0, 40, 4000)] + rng.integers(-3, 4, (4000, 8))).astype(float)
    top = float((v.astype(float) ** 2).sum(1).max())
    lift = np.sqrt(top - (v.astype(float) ** 2).sum(1))
    p = pivots.spread(np.c_[v, lift], 32)
    table = pivots.distances(v.astype(float), lift, v[p].astype(float), lift[p])
    seen, real = [], pivots.products

    def counting(a, b):
        seen.append(len(a))
        return real(a, b)

    pivots.products = counting
    try:
        q = v[7]
        to = pivots.distances(q[None].astype(float), np.zeros(1), v[p].astype(float), lift[p])[0]
        score, ids = pivots.search(q, 7, to, v, np.arange(4000), table, top, 10, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    finally:
        pivots.products = real
    exact = v @ q
    want = [i for i in np.lexsort((np.arange(4000), -exact)) if i != 7][:10]
    assert list(ids) == want and sum(seen) < 4000
    floor, seen[:] = int(np.sort(exact)[-40]), []
    again = pivots.search(q, 7, to, v, np.arange(4000), table, top, 10, (np.zeros(0, np.int64), np.zeros(0, np.int64)), floor)
    assert list(again[1]) == want
