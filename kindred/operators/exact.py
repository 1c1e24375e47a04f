"""Exact duplicates by a cascade from cheap to expensive: size, hash of the first bytes, full hash.

Rows that hold their content are hashed where they are read, in one pass. Files that are known by
path alone are read as little as possible: only those whose size occurs twice are opened, and only
those whose first bytes do are read whole. Either way what is written, counted and grouped are
digests; content is dealt out anew only where the whole input is small (see ``spread``)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.hashing import by_path, file_hash, file_prehash, fullhash, prehash
from kindred.operators.prefilter import RATE, BloomFilter
from kindred.operators.ranking import ranked, tallied
from kindred.plans.tables import bounded, keep_in, materialize, size_of, spread
from kindred.schema import BROADCAST_BYTES, PREHASH_BYTES
from kindred.sources import cache as hash_cache


def size_groups(files: DataFrame) -> DataFrame:
    """(size, files, total_size, potential_savings) of sizes above 0 that occur twice."""
    n = F.count(F.lit(1))
    return files.filter("size > 0").groupBy("size").agg(n.alias("files")).filter("files > 1").select("size", "files", (F.col("size") * F.col("files")).alias("total_size"), (F.col("size") * (F.col("files") - 1)).alias("potential_savings"))


def size_stats(files: DataFrame) -> DataFrame:
    """One row of counts over the size histogram."""
    sizes = files.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    some, twice = F.col("size") > 0, (F.col("size") > 0) & (F.col("n") > 1)
    zero = F.lit(0).cast("long")
    total = lambda cond, value: F.coalesce(F.sum(F.when(cond, value)), zero)
    out = sizes.agg(
        total(F.lit(True), F.col("n")).alias("total_files"), total(F.lit(True), F.col("n") * F.col("size")).alias("total_size"),
        F.count(F.when(some, 1)).alias("unique_sizes"), total(twice, F.col("n")).alias("potential_duplicates"),
        total(some & (F.col("n") == 1), F.col("n")).alias("eliminated_unique"), total(~some, F.col("n")).alias("empty_files"),
        F.count(F.when(twice, 1)).alias("duplicate_groups"), total(twice, F.col("size") * (F.col("n") - 1)).alias("max_potential_savings"),
    )
    return out.withColumn("elimination_rate", F.when(F.col("total_files") > 0, F.col("eliminated_unique") * 100.0 / F.col("total_files")).otherwise(0.0))


def keep_rows(rows: DataFrame, keys: DataFrame, on: list[str], rate: float = RATE) -> DataFrame:
    """Rows whose ``on`` values are among ``keys`` (each once). A short list goes to every task. A
    long one goes as a Bloom filter first, so that few rows but those that stay are shuffled to meet
    the list itself."""
    keys = materialize(keys.select(*on), "keys")
    if size_of(keys) > BROADCAST_BYTES:
        rows = rows.filter(BloomFilter.of(keys, rate).may_hold(rows, *on))
    return keep_in(rows, keys, on)


def same_size(files: DataFrame) -> DataFrame:
    """Files whose size occurs twice."""
    return keep_rows(files.filter("size > 0"), size_groups(files), ["size"])


def _known(files: DataFrame, cache: DataFrame | None, column: str) -> DataFrame:
    """Adds ``_known``: what the cache has in ``column`` for path, size and time, else null."""
    if cache is None:
        return files.withColumn("_known", F.lit(None).cast("string"))
    return hash_cache.looked_up(files, cache, column).withColumnRenamed(column, "_known").drop("hit")


def _read(files: DataFrame, cache: DataFrame | None, cached: str, read, out: str) -> DataFrame:
    """Adds ``out``, from the cache or else from the file, ``<out>_hit`` and, where the file could
    not be read, ``error``."""
    rows = _known(files, cache, cached).withColumn("_read", read(F.when(F.col("_known").isNull(), F.col("path"))))
    rows = rows.withColumn(out, F.coalesce("_known", "_read.value")).withColumn(f"{out}_hit", F.col("_known").isNotNull())
    return rows.withColumn("error", F.col("_read.error")).drop("_known", "_read")


def digested(files: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Files with prehash and hash in place of their content, written once; prehash_hit and hash_hit
    tell what came from the cache, error why a file has no digest.

    With content in the rows all that are not empty are there. Without, only files whose size
    occurs twice have a prehash, and only those whose first bytes do have a hash; of a file that is
    no longer than its first bytes the two are one."""
    if "content" in files.columns:
        rows = files.filter("size > 0")
        none = F.lit(None).cast("string")
        rows = rows.withColumns({"_prehash": none, "_fullhash": none}) if cache is None else hash_cache.known(rows, cache, "prehash", "fullhash")
        error = F.when(F.col("content").isNull(), F.lit("no content"))
        rows = spread(rows).select(
            *[c for c in files.columns if c not in ("content", "text")], F.when(error.isNull(), F.coalesce("_prehash", prehash(F.col("content")))).alias("prehash"),
            F.when(error.isNull(), F.coalesce("_fullhash", fullhash(F.col("content")))).alias("hash"), F.col("_prehash").isNotNull().alias("prehash_hit"), F.col("_fullhash").isNotNull().alias("hash_hit"), error.alias("error"),
        )
        return materialize(rows, "digests")
    heads = materialize(_read(same_size(files), cache, "prehash", file_prehash, "prehash"), "prehashes")
    twice = heads.filter("prehash IS NOT NULL").groupBy("prehash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    wanted = keep_rows(heads.filter("prehash IS NOT NULL"), twice, ["prehash"])
    none = F.lit(None).cast("string")
    short = wanted.filter(F.col("size") <= PREHASH_BYTES).withColumn("hash", F.col("prehash")).withColumn("hash_hit", F.col("prehash_hit"))
    long = _read(wanted.filter(F.col("size") > PREHASH_BYTES).drop("error"), cache, "fullhash", file_hash, "hash").select(*short.columns)
    alone = heads.filter("prehash IS NULL").unionByName(heads.filter("prehash IS NOT NULL").join(twice.select("prehash"), "prehash", "left_anti"))
    rest = alone.withColumn("hash", none).withColumn("hash_hit", F.lit(False))
    return materialize(short.unionByName(long).unionByName(rest), "digests")


def prehashed(files: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """Same-size files with the hash of their first bytes."""
    rows = digested(files) if digests is None else digests
    return same_size(rows.filter("prehash IS NOT NULL"))


def prehash_candidates(files: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """(prehash, files) of first bytes that occur twice among same-size files, whatever the size."""
    return prehashed(files, digests).groupBy("prehash").agg(F.count(F.lit(1)).alias("files")).filter("files > 1")


def _second_digest(files: DataFrame) -> DataFrame:
    """(path, _class) of files: digests of two more families over the whole content, taken where the
    content is read."""
    if "content" in files.columns:
        return files.select("path", F.concat(F.sha2("content", 512), F.md5("content"), F.octet_length("content").cast("string")).alias("_class"))
    other = by_path(lambda p, f: hashlib.file_digest(f, "blake2b").hexdigest())
    return files.select("path", F.coalesce(other(F.col("path"))["value"], F.col("path")).alias("_class"))


def exact_members(files: DataFrame, paranoid: bool = False, digests: DataFrame | None = None) -> DataFrame:
    """One row per file of a group of equal content: hash, size, rank_in_group (1: the file that
    stands for the group, by path) and the file's columns. ``paranoid`` compares digests of other
    families too; contents are read once more for it and do not move."""
    rows = (digested(files) if digests is None else digests).filter("hash IS NOT NULL")
    rows = rows.drop("prehash_hit", "hash_hit", "error")
    counts = materialize(tallied(rows, "hash", rows.count()).filter("n > 1"), "groups")
    found = rows.join(bounded(counts.drop("n")), "hash", "left_semi")
    keys = ["hash"]
    if paranoid:
        keys = ["hash", "_class"]
        found = found.join(_second_digest(files if "content" in files.columns else found), "path")
        found = materialize(found, "compared")
        counts = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        found = found.join(counts.drop("n"), keys, "left_semi")
    return ranked(found, keys, ["path"], "rank_in_group", counts).drop("_class")


def exact_groups(members: DataFrame) -> DataFrame:
    """(hash, size, files, total_size, wasted_space, duplicate_count) of each group."""
    first = F.sum(F.when(F.col("rank_in_group") == 1, F.col("size")))
    return members.groupBy("hash").agg(
        F.max(F.when(F.col("rank_in_group") == 1, F.col("size"))).alias("size"), F.count(F.lit(1)).alias("files"), F.sum("size").alias("total_size"),
        (F.sum("size") - first).alias("wasted_space"), (F.count(F.lit(1)) - 1).alias("duplicate_count"),
    )


def scan_summary(files: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: the scan's files, and its exact groups (similar ones do not count here)."""
    zero = F.lit(0).cast("long")
    total = files.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("size"), zero).alias("total_size"))
    found = groups.agg(F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum("duplicate_count"), zero).alias("duplicate_files"), F.coalesce(F.sum("wasted_space"), zero).alias("reclaimable_space"))
    out = total.withColumn("_one", F.lit(1)).join(found.withColumn("_one", F.lit(1)), "_one").drop("_one")  # one row each
    return out.withColumn("wasted_percentage", F.when(F.col("total_size") > 0, F.col("reclaimable_space") * 100.0 / F.col("total_size")).otherwise(0.0))
