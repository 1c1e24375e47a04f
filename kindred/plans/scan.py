"""The whole scan as one plan: filters, exact cascade, near copies, one list of groups."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.hashing import simhash
from kindred.functions.paths import in_category
from kindred.operators import dedupe, exact, similar
from kindred.operators.predicates import in_references, passed
from kindred.plans.tables import materialize, spread
from kindred.schema import IMAGE_THRESHOLDS, ScanOptions
from kindred.sources import cache as hash_cache
from kindred.sources import documents, images
from kindred.sources.cache import CacheLog
from kindred.sources.files import normalized_roots, root_ignores, walk


class ScanError(RuntimeError):
    """A strict scan met files that it could not read."""


@dataclass
class Scan:
    """members: group_id, is_similar, path, size, rank_in_group, is_reference. summary: one row.
    errors: (path, error). files: the rows that passed the filters, without content. cache: the hash
    cache with what this scan found out, if it was given one."""

    members: DataFrame
    summary: DataFrame
    errors: DataFrame
    files: DataFrame
    cache: DataFrame | None = None

    def details(self) -> DataFrame:
        """Members with modified and group_name, as selections and exports take them."""
        return self.members.join(self.files.select("path", "modified", "group_name"), "path")


def fingerprinted(files: DataFrame) -> DataFrame:
    """Documents with a text, with their fingerprint as ``hash``; others have none."""
    return spread(files).withColumn("hash", simhash(F.when(in_category(F.col("path"), "documents"), F.col("text"))))


def _prints(files: DataFrame, cache: DataFrame | None) -> DataFrame:
    """(path, size, hash) of documents: by the cache, by their text, or by the text that can be had
    from their content or file. No text, no hash; a filter here would compute them twice."""
    rows = files.filter(in_category(F.col("path"), "documents"))
    known = F.lit(None).cast("long")
    if cache is not None:
        rows = hash_cache.looked_up(rows, cache, "document_fingerprint").drop("hit")
        known = F.col("document_fingerprint")
    todo = known.isNull()
    if "text" in files.columns:
        text = F.when(todo, F.col("text"))
    elif "content" in files.columns:
        text = documents.extracted(F.col("path"), F.when(todo, F.col("content")))
    else:
        text = documents.read(F.when(todo, F.col("path")))["value"]
    rows = spread(rows).withColumn("_text", text)
    return rows.select(*[c for c in ("path", "size", "mtime_ns", "inode") if c in files.columns], F.coalesce(known, simhash(F.col("_text"))).alias("hash"), known.isNotNull().alias("hit"))


def _image_hashes(files: DataFrame, algorithm: str, cache: DataFrame | None) -> DataFrame:
    """(path, size, hash) of images: by the column perceptual_hash where rows have one, else by the
    cache, or their content or file. Images that cannot be decoded have none."""
    rows = files.filter(in_category(F.col("path"), "images"))
    keep = [c for c in ("path", "size", "mtime_ns", "inode") if c in files.columns]
    if "perceptual_hash" in files.columns:
        return rows.select(*keep, F.col("perceptual_hash").alias("hash"), F.lit(False).alias("hit"))
    known = F.lit(None).cast("long")
    if cache is not None:
        rows = hash_cache.looked_up(rows, cache.filter(F.col("algo") == algorithm), "perceptual_hash").drop("hit")
        known = F.col("perceptual_hash")
    if "content" in files.columns:
        read = images.content_hash(algorithm)(F.when(known.isNull(), F.col("content")))
    else:
        read = images.image_hash(algorithm)(F.when(known.isNull(), F.col("path")))["value"].cast("long")
    rows = spread(rows).withColumn("_read", read)
    return rows.select(*keep, F.coalesce(known, F.col("_read")).alias("hash"), known.isNotNull().alias("hit"))


def _new_entries(digests: DataFrame, prints: dict[str, DataFrame], now: int, algorithm: str) -> DataFrame:
    """What the cache did not know, a row for each file."""
    keys = ["path", "size", "mtime_ns", *(["inode"] if "inode" in digests.columns else [])]
    found = digests.select(*keys, F.when(~F.col("prehash_hit"), F.col("prehash")).alias("prehash"), F.when(~F.col("hash_hit"), F.col("hash")).alias("fullhash"))
    for column, rows in prints.items():
        more = rows.filter("NOT hit").select(*keys, F.col("hash").alias(column))
        found = found.unionByName(more, allowMissingColumns=True)
    hashes = [c for c in hash_cache.HASHES if c in found.columns]
    rows = found.groupBy(*keys).agg(*[F.max(c).alias(c) for c in hashes]).filter(F.coalesce(*[F.col(c).cast("string") for c in hashes]).isNotNull())
    if "perceptual_hash" in hashes:
        rows = rows.withColumn("algo", F.when(F.col("perceptual_hash").isNotNull(), F.lit(algorithm)))
    return rows.withColumn("created_at", F.lit(now).cast("long"))


def scan_rows(files: DataFrame, options: ScanOptions = ScanOptions(), errors: DataFrame | None = None, cache: DataFrame | CacheLog | None = None, now: int = 0) -> Scan:
    """Scan file rows: with ``content`` (and ``text``) in them, or read by path. ``errors``: files
    that the walk could not look at. With a hash cache what it knows for path, size and time is not
    read or hashed again; it needs ``mtime_ns`` in the rows, and ``now`` dates what is new. To a
    cache that is a log what is new is appended, and nothing else is written."""
    spark = files.sparkSession
    log = cache if isinstance(cache, CacheLog) else None
    if log is not None:
        cache = log.current()
    kept = passed(files, options)
    if options.named_roots:
        names = spark.createDataFrame(list(options.named_roots.items()), "root string, name string")  # a row for each root
        kept = dedupe.named(kept, names)
    if "inode" in files.columns and "dev" in files.columns:
        kept = dedupe.without_hardlinks(kept)
    if "content" not in files.columns:
        kept = materialize(kept, "files")
    digests = exact.digested(kept, cache)
    failed = digests.filter("error IS NOT NULL").select("path", "error")
    errors = materialize(failed if errors is None else errors.unionByName(failed), "errors")
    if options.strict and (first := errors.orderBy("path").first()):
        raise ScanError(f"{first['path']}: {first['error']}")
    found = exact.exact_members(kept, options.paranoid, digests)
    found = materialize(found.select("hash", "path", "size", "rank_in_group"), "exact")
    near, prints = [], {}
    if options.similar_images:
        most = IMAGE_THRESHOLDS[options.image_algorithm] if options.image_threshold is None else options.image_threshold
        prints["perceptual_hash"] = materialize(_image_hashes(kept, options.image_algorithm, cache), "image_hashes").filter("hash IS NOT NULL")
        groups = similar.leader_groups(prints["perceptual_hash"].select("path", "size", "hash"), most, options.min_group_size)
        near.append(similar.not_covered(materialize(groups, "image_groups"), found).withColumn("fill", F.lit("f")))
    if options.similar_documents:
        prints["document_fingerprint"] = materialize(_prints(kept, cache), "fingerprints").filter("hash IS NOT NULL")
        groups = similar.leader_groups(prints["document_fingerprint"].select("path", "size", "hash"), options.document_threshold, options.min_group_size)
        near.append(similar.not_covered(materialize(groups, "document_groups"), found).withColumn("fill", F.lit("0")))
    if near:
        members = similar.all_groups(found, reduce(DataFrame.unionByName, near))
    else:
        members = found.select(F.col("hash").alias("group_id"), F.lit(False).alias("is_similar"), "path", "size", "rank_in_group")
    rows = digests.drop("prehash", "hash", "prehash_hit", "hash_hit", "error") if "content" in files.columns else kept
    summary = exact.scan_summary(rows.select("size"), exact.exact_groups(found))
    if cache is not None:
        hits = digests.agg(F.count_if("prehash_hit").alias("cache_prehash_hits"), F.count_if("hash_hit").alias("cache_fullhash_hits"))
        summary = summary.withColumn("_one", F.lit(1)).join(hits.withColumn("_one", F.lit(1)), "_one").drop("_one")  # one row each
        entries = _new_entries(digests, prints, now, options.image_algorithm)
        if log is not None:
            log.append(entries)
            cache = log.current()
        else:
            cache = hash_cache.merged(cache, entries)
    return Scan(members.withColumn("is_reference", in_references(options.references)), summary, errors, rows, cache)


def find_duplicates(files: DataFrame, options: ScanOptions = ScanOptions()) -> tuple[DataFrame, DataFrame]:
    """(members, summary) of file rows. Images are told by a column ``perceptual_hash``, if there is
    one, made by ``image_algorithm``."""
    out = scan_rows(files, options)
    return out.members, out.summary


def scan(spark: SparkSession, paths: list[str], options: ScanOptions = ScanOptions(), cache: DataFrame | CacheLog | None = None, now: int = 0) -> Scan:
    """Scan folders that all executors can read. Of several paths the first is a reference, too, as
    given. The .gitignore of a root comes before the patterns of the options; named roots are
    folders by any path."""
    for p in (*paths, *options.references):
        if not os.path.isdir(p):
            raise ScanError(f"not a folder: {p}")
    roots = normalized_roots(paths)
    references = [os.path.realpath(r) for r in (*paths[: len({os.path.realpath(p) for p in paths}) > 1], *options.references)]
    options = replace(
        options, references=tuple(dict.fromkeys(references)), root_ignore=root_ignores(roots),
        named_roots={os.path.realpath(r): name for r, name in options.named_roots.items()},
    )
    ignore = {r: [*options.root_ignore.get(r, ()), *options.ignore] for r in roots}
    files, errors = walk(spark, paths, options.follow_symlinks, options.skip_hidden, ignore)
    return scan_rows(files, options, errors, cache, now)
