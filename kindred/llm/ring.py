"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring; a row's key hashes to a point and belongs to the
first virtual node clockwise. A shard takes no more rows than its bound; rows beyond it walk on
clockwise to the next virtual node whose shard has room. With a bound of (1 + epsilon) times the
mean the load is balanced by construction and a change of the shard count moves few rows; with
epsilon 0 the bounds are the floor and ceiling of the mean, so counts differ by one at most.

Scale: rows are counted by ring point (a fixed number of points), the walk is played out on those
counts alone, and what comes out - rank ranges of a point that go to a shard - is a table bounded
by the ring's size. Rows then find their range by their rank within the point. Points that a hot
key fills are split into cells before they are ranked.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import gapless_rank, materialize

#: Rows that one task may rank together before a ring point is split into cells.
CELL_ROWS = 1 << 16


def ring_points(shards: int, vnodes: int) -> int:
    """Points on the ring: a power of two, at least 4 for each virtual node."""
    return 1 << max(10, (4 * shards * vnodes - 1).bit_length())


def ring_nodes(shards: int, vnodes: int, points: int) -> list[tuple[int, int]]:
    """(point, shard) of every virtual node, clockwise. A shard's nodes depend on its number alone
    (but for a taken point, which yields to the next free one), so more shards leave them in place,
    and so does a finer ring, since nodes and keys are cut from the front of their hashes."""
    at: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            p = int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest()) * points >> 64
            while p in at:
                p = (p + 1) % points
            at[p] = s
    return sorted(at.items())


def bounds(total: int, shards: int, epsilon: float) -> list[int]:
    """The most rows that each shard takes."""
    if epsilon > 0:
        return [ceil((1 + epsilon) * total / shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], limit: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Play the overflow out on counts by point: (point, first rank, end rank, shard, first slot).

    All rows try their own node first, then the overflow of each point moves on one node at a
    time; within a round, nodes serve their points clockwise. A row has passed every shard after
    one turn, so the rounds are bounded by the number of nodes."""
    places = [p for p, _ in nodes]
    left = [(p, 0, n, bisect_left(places, p) % len(nodes)) for p, n in sorted(counts.items()) if n]
    free, slot, plan = list(limit), [0] * len(limit), []
    while left:
        on = []
        for point, rank, end, node in left:
            s = nodes[node][1]
            if n := min(free[s], end - rank):
                plan.append((point, rank, rank + n, s, slot[s]))
                free[s] -= n
                slot[s] += n
            if rank + n < end:
                on.append((point, rank + n, end, (node + 1) % len(nodes)))
        left = on
    return plan


def shard(df: DataFrame, key: str, shards: int = 8, vnodes: int = 128, epsilon: float = 0.0) -> DataFrame:
    """Add ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in each shard) to every row.

    Null keys hash like any other value. Repeated rows and hot keys are rows like all others: the
    bound is on rows, so a hot key overflows into further shards. An empty table stays empty.
    Columns of the input named ``shard`` or ``slot`` are replaced; all others are kept. Rows of a
    point are ranked by a hash of the whole row, whatever partitions they come in, so that reruns
    agree and a changed bound moves the last few only; texts of any length count as one row.
    """
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    points = ring_points(shards, vnodes)
    rows = materialize(
        df.select(
            *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)],
            F.shiftrightunsigned(F.xxhash64(F.col(f"`{key}`")), 64 - (points.bit_length() - 1)).cast("int").alias("_point"),
            F.xxhash64(*[F.col(f"`{c}`") for c in keep]).alias("_h"),
            F.monotonically_increasing_id().alias("_uid"),
        ),
        "ring",
    )
    counts = {r["_point"]: r["count"] for r in rows.groupBy("_point").count().collect()}  # one row for each ring point at most
    total = sum(counts.values())
    plan = walk(counts, ring_nodes(shards, vnodes, points), bounds(total, shards, epsilon))
    spark = df.sparkSession
    most = max(CELL_ROWS, 4 * total // points)
    hot = spark.createDataFrame([(p, (-(-n // most) - 1).bit_length()) for p, n in counts.items() if n > most], "_hot int, _bits int")  # a row for each ring point at most
    # The cells of a hot point are ranges of the row hash, so a row's rank does not depend on how rows are dealt.
    part = F.expr("shiftrightunsigned(shiftrightunsigned(_h, 1), 63 - _bits)").cast("int")
    cells = rows.join(F.broadcast(hot), rows["_point"] == hot["_hot"], "left").withColumn("_part", F.coalesce(part, F.lit(0))).drop("_hot", "_bits")
    # A range that stays large holds equal rows, any of which may stand for the others.
    again = cells.groupBy("_point", "_part").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 4 * most).select(F.col("_point").alias("_p"), F.col("_part").alias("_q"), F.ceil(F.col("_n") / most).cast("int").alias("_subs"))
    cells = cells.join(F.broadcast(again), (F.col("_point") == F.col("_p")) & (F.col("_part") == F.col("_q")), "left")  # fewer than total / most rows
    cells = cells.withColumn("_cell", F.struct("_part", F.coalesce(F.pmod(F.xxhash64("_uid"), F.col("_subs")), F.lit(0)).alias("sub"))).drop("_p", "_q", "_subs", "_part")
    ranked = gapless_rank(cells, ["_point"], "_cell", [F.col("_h"), F.col("_uid")], "_rank")
    ranges = spark.createDataFrame(plan, "_p int, _from long, _to long, shard int, _slot long")  # bounded by the ring, not by the rows
    placed = ranked.join(F.broadcast(ranges), (F.col("_point") == F.col("_p")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "shard", (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"))


def op1_ring(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7; the counts of any two shards differ by one at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.col("text")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"))
    out = shard(rows, "doc_id", shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
