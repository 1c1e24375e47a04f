"""Rows that stand for the same file: hard links, canonical paths, nested roots."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def without_hardlinks(files: DataFrame) -> DataFrame:
    """The first path of each (root, dev, inode); rows without an inode all stay. Only files that
    have other names, where ``is_hardlink`` tells, are looked at."""
    linked = F.col("dev").isNotNull() & F.col("inode").isNotNull()
    if "is_hardlink" in files.columns:
        linked = linked & F.col("is_hardlink")
    first = files.filter(linked).groupBy(F.col("root").alias("_root"), F.col("dev").alias("_dev"), F.col("inode").alias("_inode")).agg(F.min("path").alias("_path"))
    same = F.col("root").eqNullSafe(F.col("_root")) & (F.col("dev") == F.col("_dev")) & (F.col("inode") == F.col("_inode")) & (F.col("path") == F.col("_path"))
    return files.filter(linked).join(first, same, "left_semi").unionByName(files.filter(~F.coalesce(linked, F.lit(False))))


class HardlinkTracker:
    """The same for files that come one by one: by (device, inode) of their stat."""

    def __init__(self):
        self.seen: set[tuple[int, int]] = set()

    def check(self, s) -> bool:
        """Whether another name of this file was recorded."""
        return (s.st_dev, s.st_ino) in self.seen

    def record(self, s) -> bool:
        """Remember a file; whether it was new."""
        new = not self.check(s)
        self.seen.add((s.st_dev, s.st_ino))
        return new

    def is_hardlink(self, s) -> bool:
        return not self.record(s)

    def clear(self) -> None:
        self.seen.clear()


def distinct_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """The first row of each path, by modification time, then size, then path."""
    order = [c for c in ("modified", "size", "path") if c in files.columns and c != path]
    rest = [c for c in files.columns if c != path and c not in order]
    row = F.min_by(F.struct(*files.columns), F.struct(*order, *rest)) if order + rest else F.struct(F.first(path).alias(path))
    return files.groupBy(F.col(path).alias("_key")).agg(row.alias("_row")).select("_row.*")


def outer_roots(roots: DataFrame) -> DataFrame:
    """Roots (root) that are not below another one: every proper ancestor is looked up by equality."""
    clean = roots.select(F.when(F.col("root") == "/", F.lit("")).otherwise(F.rtrim("root", F.lit("/"))).alias("root")).distinct()
    parts = F.split("root", "/")
    above = clean.select("root", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit("~")).otherwise(F.array_join(F.slice(parts, 1, n), "/")))).alias("_above"))
    nested = above.join(clean.select(F.col("root").alias("_above")), "_above", "left_semi").select("root").distinct()
    return clean.join(nested, "root", "left_anti").select(F.when(F.col("root") == "", F.lit("/")).otherwise(F.col("root")).alias("root"))


def named(files: DataFrame, names: DataFrame) -> DataFrame:
    """Label files with the name of their root, from (root, name)."""
    return files.drop("group_name").join(names.select("root", F.col("name").alias("group_name")), "root", "left")


@F.pandas_udf(T.StringType())
def path_key(paths: pd.Series) -> pd.Series:
    """Paths in Unicode normal form C, so that equal keys are equal paths."""
    return paths.map(lambda p: unicodedata.normalize("NFC", p), na_action="ignore")
