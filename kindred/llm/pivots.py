"""Exact top-k search by pivot-table elimination.

Scores are inner products of whole-number vectors. With one more component, sqrt(M - |x|^2) for a
row and 0 for a query (M: the largest squared length), a larger product is a smaller Euclidean
distance, so the triangle inequality holds: for every pivot p, |d(q, p) - d(x, p)| is a lower
bound of d(q, x). Distances of all rows to the pivots are computed once and kept with the rows.

Queries come in blocks that every task holds. The sample that pivots are chosen from also gives
each query k scores, and so a distance that its results cannot exceed, whichever task looks. In a
task, pivot after pivot eliminates the rows whose bound is beyond that reach; what is left is
evaluated in the order of the greatest bound, some at a time, until the next bound is beyond the
k-th best distance found; ties in score stay in. A task passes on at most k rows for a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import materialize, ship

SCALE, PIVOTS, TOP = 1024, 32, 10
#: Rows that pivots are chosen from; queries in a block; candidates evaluated between two looks at
#: the stopping rule; bytes of rows that are searched together; pivots tried at a time.
PIVOT_SAMPLE, QUERY_BLOCK, CHUNK, ROW_BYTES, STEP = 2000, 16_384, 512, 32 << 20, 4
#: Bounds are floating point; a candidate is only left out beyond this share of the lengths.
SLACK = 1e-6
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers: by doubles where those are exact, else by Python's integers.
    Products beyond a long are the nearest long."""
    big = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if big < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(a) @ whole(b).T if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.clip(exact, LEAST, MOST).astype(np.int64)


def distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    """Euclidean distances in the lifted space, (rows, pivots)."""
    out = ((x**2).sum(1) + lift**2)[:, None] + ((pivots**2).sum(1) + pivot_lift**2)[None, :] - 2 * (x @ pivots.T + lift[:, None] * pivot_lift[None, :])
    return np.sqrt(np.maximum(out, 0))


def spread(x: np.ndarray, count: int) -> np.ndarray:
    """Indices of rows far from each other: each is the farthest from those before it."""
    if not len(x) or not count:
        return np.zeros(0, int)
    picked = [int(np.argmax((x**2).sum(1)))]
    near = ((x - x[picked[0]]) ** 2).sum(1)
    while len(picked) < min(count, len(x)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(1))
    return np.array(picked)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, ~score))[:k]  # the complement turns the order round, at the least long too


def reach(length: float, score: float) -> float:
    """The distance of a row of this score, and some doubt; ``length``: |q|^2 + M."""
    d = length - 2.0 * score
    return np.inf if score <= LEAST or not np.isfinite(d) else np.sqrt(max(0.0, d)) + SLACK * np.sqrt(length + 1)


def search(query: np.ndarray, own: int, to_pivots: np.ndarray, vectors: np.ndarray, ids: np.ndarray, table: np.ndarray, top: float, k: int, held: tuple[np.ndarray, np.ndarray], floor: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The best k of ``held`` (scores, ids) and these rows, but for rows that ``floor`` rules out: a
    score that k rows are known to reach. top: the largest squared length."""
    length = float((query**2).sum()) + top
    score, found = held
    far = reach(length, max(floor, int(score.min())) if len(score) == k else floor)
    left, bound = np.flatnonzero(ids != own), None
    for at in range(0, table.shape[1], STEP):
        near = np.abs(table[left, at : at + STEP] - to_pivots[at : at + STEP]).max(axis=1)
        bound = near if bound is None else np.maximum(bound, near)
        on = bound <= far
        left, bound = left[on], bound[on]
    if bound is None:
        bound = np.zeros(len(left))
    order = np.argsort(bound, kind="stable")
    at, size = 0, CHUNK
    while at < len(order) and bound[order[at]] <= far:
        rows = left[order[at : at + size]]
        at += size
        size *= 2
        score, found = np.r_[score, products(vectors[rows], query[None, :])[:, 0]], np.r_[found, ids[rows]]
        keep = best(score, found, k)
        score, found = score[keep], found[keep]
        if len(score) == k:
            far = min(far, reach(length, int(score.min())))
    return score, found


def top_products(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = TOP, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` (key, vector) the k rows of
    ``df`` with the highest products, other than rows of its own key.

    Components are floor(1024 * x) in double arithmetic, of any size; a score beyond a long is
    given, and ranked, as the nearest long. Vectors that are null, or hold a null or a component
    that is not finite after scaling, take no part; nor do rows without a key. Shorter vectors are
    as if filled up with zeros. Every row counts: repeated rows are candidates each, and each query
    row gets its own results. Equal scores go to the smaller key, so the result is the same in
    every run. Empty tables give no rows. Queries are worked off in blocks of ``QUERY_BLOCK``, each
    a pass over the pivot table; other columns of the input are not read.
    """
    spark = df.sparkSession
    ship(spark)

    def indexed(x: DataFrame) -> DataFrame:
        """Whole numbers stay doubles: a scaled double beyond 2^53 is whole as it is."""
        scaled = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda c: c * F.lit(float(SCALE)))
        out = x.select(F.col(f"`{key}`").cast("long").alias("id"), scaled.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
        usable = F.forall("v", lambda c: F.coalesce((F.abs(c) < F.lit(float("inf"))), F.lit(False)))  # NaN is above infinity
        whole = F.transform("v", lambda c: F.when(F.abs(c) < F.lit(2.0**53), F.floor(c).cast("double")).otherwise(c))
        return out.filter(usable).select("id", whole.alias("v"))

    rows = indexed(df).withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    rows = materialize(rows, "vectors")
    asked = indexed(queries).groupBy("id", "v").agg(F.count(F.lit(1)).alias("times")).withColumn("qid", F.monotonically_increasing_id())
    asked = materialize(asked.withColumn("slot", F.xxhash64("id", "v")), "queries")
    schema = "query_id long, rank int, vec_id long, score long"
    top, wide, total = rows.agg(F.max("norm"), F.max(F.size("v")), F.count(F.lit(1))).first()
    n_asked, wide_asked, times = asked.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max("times")).first()
    if not total or not n_asked:
        return spark.createDataFrame([], schema)
    wide = max(wide, wide_asked)

    def matrix(column: pa.Array) -> np.ndarray:
        """Lists of doubles as rows of equal width."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        flat, sizes = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
        out = np.zeros((len(column), wide))
        out[np.arange(wide) < sizes[:, None]] = flat
        return out

    rate = min(1.0, 1.5 * PIVOT_SAMPLE / total)
    in_sample = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30))
    sample = rows.filter(in_sample < rate * (1 << 30)).orderBy(F.xxhash64("id", "v"), "id").limit(PIVOT_SAMPLE).select("id", "v").toArrow()
    sample_ids, known = sample["id"].to_numpy(), matrix(sample["v"])
    if np.isfinite(top):
        picked = spread(np.c_[known, np.sqrt(np.maximum(top - (known**2).sum(1), 0))], pivots)
    else:  # squares overflow: no bounds, every candidate is evaluated
        picked = np.zeros(0, int)
    x = known[picked]
    lift = np.sqrt(np.maximum(top - (x**2).sum(1), 0)) if len(x) else np.zeros(0)

    def with_table(batches):
        for batch in batches:
            m = matrix(batch.column(1))
            d = distances(m, np.sqrt(np.maximum(top - (m**2).sum(1), 0)), x, lift) if len(x) else np.zeros((len(m), 0))
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cells], names=["id", "v", "d"])

    table = materialize(rows.select("id", "v").mapInArrow(with_table, "id long, v array<double>, d array<double>"), "pivot_table")
    n_blocks = -(-n_asked * 5 // (4 * QUERY_BLOCK)) if n_asked > QUERY_BLOCK else 1
    parts = []
    for block in range(n_blocks):
        own = asked.filter(F.pmod(F.col("slot"), F.lit(n_blocks)) == block).orderBy("qid").toArrow()  # about QUERY_BLOCK rows
        if not own.num_rows:
            continue
        q = matrix(own["v"])
        own_ids = own["id"].to_numpy()
        floors = np.full(len(q), LEAST, np.int64)
        for at in range(0, len(q), 1024):
            s = products(q[at : at + 1024], known)
            for j, (line, one) in enumerate(zip(s, own_ids[at : at + 1024])):
                others = line[sample_ids != one]
                if len(others) >= k:
                    floors[at + j] = np.partition(others, len(others) - k)[len(others) - k]
        sent = spark.sparkContext.broadcast((own["qid"].to_numpy(), own_ids, q, floors))

        def scan(batches, sent=sent):
            qids, ids_of, q, floors = sent.value
            to_pivots = distances(q, np.zeros(len(q)), x, lift) if len(x) else np.zeros((len(q), 0))
            held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
            for t in gathered(batches, max(1, ROW_BYTES // (8 * (wide + len(x) + 1)))):
                ids, v = t["id"].to_numpy(), matrix(t["v"])
                d = t["d"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
                for j in range(len(q)):
                    held[j] = search(q[j], ids_of[j], to_pivots[j], v, ids, d, top, k, held[j], int(floors[j]))
            held = [(s[s >= f], i[s >= f]) for (s, i), f in zip(held, floors)]
            counts = [len(s) for s, _ in held]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(qids, counts)), pa.array(np.repeat(ids_of, counts)),
                pa.array(np.concatenate([i for _, i in held])), pa.array(np.concatenate([s for s, _ in held])),
            ], names=["qid", "query_id", "vec_id", "score"])

        near = table.mapInArrow(scan, "qid long, query_id long, vec_id long, score long")
        if n_blocks > 1:
            near = materialize(near, "nearest")
            sent.unpersist()
        parts.append(near)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    if times > 1:
        often = asked.filter("times > 1").select(F.col("qid").alias("_q"), "times")
        found = found.join(often, found["qid"] == often["_q"], "left").withColumn("_t", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1)))))
    return found.select("query_id", "rank", "vec_id", "score")


def gathered(batches, most: int):
    """Tables of up to about ``most`` rows, more where one batch has more."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def op3_pivots(spark, sf_dir: str) -> DataFrame:
    """The ten best rows for each embedding whose id is divisible by 100, among all others."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_products(rows, rows.filter(F.col("vec_id") % 100 == 0))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT vec_id, v, row_number() OVER () AS asked FROM v WHERE vec_id % 100 = 0),
p AS (SELECT asked, a.vec_id AS query_id, r.vec_id, list_inner_product(a.v, r.v)::BIGINT AS score FROM a JOIN v r ON a.vec_id <> r.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id) <= 10
"""
