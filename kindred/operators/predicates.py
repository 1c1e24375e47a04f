"""Row filters of a scan, in the order in which a scan applies them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.formatting import moment
from kindred.functions.paths import file_name, hidden, ignored, in_category, under
from kindred.schema import ScanOptions


def size_between(low: int | None = None, high: int | None = None) -> Column:
    """Both ends included."""
    out = F.lit(True)
    if low is not None:
        out = out & (F.col("size") >= low)
    return out & (F.col("size") <= high) if high is not None else out


def modified_between(low: str | None = None, high: str | None = None) -> Column:
    """Both ends included; dates and times without a zone are UTC."""
    out = F.lit(True)
    if low is not None:
        out = out & (F.col("modified") >= moment(low))
    return out & (F.col("modified") <= moment(high)) if high is not None else out


def name_matches(include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Any of ``include`` (all names, if empty) and none of ``exclude``, unanchored, on the name."""
    name = file_name(F.col("path"))
    any_of = lambda patterns: reduce(lambda a, p: a | name.rlike(p), patterns, F.lit(False))
    return (any_of(include) if include else F.lit(True)) & ~any_of(exclude)


def in_references(references: tuple[str, ...]) -> Column:
    return reduce(lambda a, r: a | under(F.col("path"), F.lit(r)), references, F.lit(False))


def relative(root: Column) -> Column:
    return F.when(F.startswith(F.col("path"), root), F.ltrim(F.substr(F.col("path"), F.length(root) + 1), F.lit("/"))).otherwise(F.ltrim(F.col("path"), F.lit("/")))


def passed(files: DataFrame, options: ScanOptions) -> DataFrame:
    """Ignore globs, symlinks, hidden names, empty files, size, date, names, categories."""
    root = F.col("root") if "root" in files.columns else F.lit("")
    keep = F.lit(True)
    if options.ignore or options.root_ignore:
        skip = ignored(relative(root), list(options.ignore))
        for r, patterns in options.root_ignore.items():
            skip = F.when(root == r, ignored(relative(root), [*patterns, *options.ignore])).otherwise(skip)
        keep = keep & ~skip
    if not options.follow_symlinks and "is_symlink" in files.columns:
        keep = keep & ~F.col("is_symlink")
    if options.skip_hidden:
        keep = keep & ~hidden(relative(root))
    keep = keep & (F.col("size") > 0) & size_between(options.min_size, options.max_size) & modified_between(options.newer_than, options.older_than)
    if options.include or options.exclude:
        keep = keep & name_matches(options.include, options.exclude)
    if options.categories:
        keep = keep & in_category(F.col("path"), *options.categories)
    return files.filter(keep)
