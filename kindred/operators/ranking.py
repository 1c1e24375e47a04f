"""Ranks inside groups of any size, sizes and numbers of groups, without a task for a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.plans.tables import bounded, materialize

#: Rows of a group, or keys, that one task may rank.
HOT_ROWS = 1 << 20
#: Rows that a task gets, about, where groups are counted; the number of tasks beyond which each gets
#: more of them; shares of a group that are counted by themselves.
TALLY_ROWS, MOST_PARTS, SHARES = 1 << 18, 1000, 16


def tallied(rows: DataFrame, key: str, many: int, first: str | None = None) -> DataFrame:
    """(key, n) of rows (key, path): how many rows a key has, and its least path as ``first``, if that
    is named. ``many``: about how many rows there are.

    As many tasks count as that number asks for: parts that are merged up to some bytes would be held,
    by key, in one. Shares of each key come first, so no task gets all rows of a frequent one."""
    least = lambda c: [F.min(c).alias(first)] if first else []
    parts = min(MOST_PARTS, 1 + many // TALLY_ROWS)
    if parts == 1:
        return rows.groupBy(key).agg(*least("path"), F.count(F.lit(1)).alias("n"))
    shares = rows.select(key, *["path"] * bool(first), F.pmod(F.xxhash64("path"), F.lit(SHARES)).alias("_share")).repartition(parts, key, "_share")
    shares = shares.groupBy(key, "_share").agg(*least("path"), F.count(F.lit(1)).alias("n"))
    return shares.repartition(parts, key).groupBy(key).agg(*least(first), F.sum("n").alias("n"))


def _in_parts(df: DataFrame, keys: list[str], order: list[str | Column], name: str, rows: int) -> DataFrame:
    """Rank by ranges: rows are dealt in the order of keys and ``order``, numbered inside the part
    that they land in, and each part's start comes from the counts by group and part."""
    parts = 1 + rows // HOT_ROWS
    dealt = materialize(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    starts = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.withColumn("_start", before).drop("_n").withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)}).withColumnRenamed("_part", "_p")
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return dealt.withColumn("_inside", inside).join(starts, same).withColumn(name, (F.col("_start") + F.col("_inside")).cast("int")).select(*df.columns, name)


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, counts: DataFrame | None = None) -> DataFrame:
    """Add ``name``: the place from 1 of each row in its group, ascending. Groups of over
    ``HOT_ROWS`` rows are ranked in parts, others in one task each. ``counts``: (keys, n), if it is
    known already."""
    n = counts if counts is not None else df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    window = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    hot = n.filter(F.col("n") > HOT_ROWS).select(*keys, "n")
    found = hot.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not found[0]:
        return df.withColumn(name, window)
    hot = bounded(materialize(hot.drop("n"), "hot"))
    held = [F.col(k).isNotNull() for k in keys]  # groups of null keys have no equal; they stay where they are
    part = _in_parts(df.filter(*held).join(hot, keys, "left_semi"), keys, order, name, found[1])
    return df.join(hot, keys, "left_anti").withColumn(name, window).unionByName(part)


def placed(df: DataFrame, order: list[str | Column], name: str, many: int | None = None) -> DataFrame:
    """Add ``name``: the place from 1 of each row among all rows. ``many``: about how many there are,
    if that is known."""
    rows = materialize(df, "placed") if many is None else df
    return _in_parts(rows.withColumn("_all", F.lit(0)), ["_all"], order, name, rows.count() if many is None else many).drop("_all")


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """The distinct values of ``key`` with their place from 1, ascending."""
    return placed(df.select(key).distinct(), [key], name)
