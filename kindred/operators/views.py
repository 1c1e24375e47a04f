"""Looking at groups: search, kinds, order, folders, sums."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.paths import parent
from kindred.operators.ranking import placed


def search(members: DataFrame, query: str) -> DataFrame:
    """Groups with a file whose path or group name matches as a regular expression, or holds the
    words as they stand, in any case. What is no valid expression to the engine that evaluates it
    is searched for as words."""
    try:
        members.sparkSession._jvm.java.util.regex.Pattern.compile(f"(?i){query}")
        as_expression = lambda c: F.coalesce(c.rlike(f"(?i){query}"), F.lit(False))
    except IllegalArgumentException:
        as_expression = lambda c: F.lit(False)
    as_words = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))
    hit = as_expression(F.col("path")) | as_words(F.col("path")) | as_expression(F.col("group_name")) | as_words(F.col("group_name"))
    return members.join(members.filter(hit).select("group_id").distinct(), "group_id", "left_semi")


def of_kind(members: DataFrame, kind: str) -> DataFrame:
    """``all``, ``exact`` or ``similar`` groups."""
    return members if kind == "all" else members.filter(F.col("is_similar") == (kind == "similar"))


def sorted_groups(members: DataFrame, by: str = "size", descending: bool = True) -> DataFrame:
    """(position, group_id, size, files, first_path) of groups by size, path, date or count, ties
    by group_id."""
    first = lambda c: F.min_by(c, "rank_in_group")
    groups = members.groupBy("group_id").agg(first("size").alias("size"), F.count(F.lit(1)).alias("files"), first("path").alias("first_path"), first("modified").alias("_date"))
    key = {"size": F.col("size"), "path": F.lower("first_path"), "date": F.col("_date"), "count": F.col("files")}[by]
    order = [F.desc("_key") if descending else F.asc("_key"), F.col("group_id")]
    return placed(groups.withColumn("_key", key), order, "position").drop("_key", "_date").orderBy("position")


def folders(members: DataFrame) -> DataFrame:
    """(group_id, folder): the distinct folders of each group."""
    return members.select("group_id", parent(F.col("path")).alias("folder")).distinct()


def group_names(members: DataFrame) -> DataFrame:
    return members.filter("group_name IS NOT NULL").select("group_id", "group_name").distinct()


def totals(members: DataFrame) -> DataFrame:
    """One row over all groups, similar ones too."""
    zero = F.lit(0).cast("long")
    groups = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"), F.min_by("size", "rank_in_group").alias("first"))
    return groups.agg(
        F.count(F.lit(1)).alias("group_count"), F.coalesce(F.sum("n"), zero).alias("total_files"), F.coalesce(F.sum(F.col("n") - 1), zero).alias("duplicate_files"),
        F.coalesce(F.sum(F.col("s") - F.col("first")), zero).alias("reclaimable_space"),
    )

