"""The hash cache: a table of the hashes of files, by path, with what they were taken of (size, time).

As a table it is merged with new entries by one join. Kept on disk it is a log: each upsert writes
its own entries and nothing else, the newest ones win when it is read, and from time to time the
log is folded into a new base."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "path string, size long, mtime_ns long, inode long, prehash string, fullhash string, perceptual_hash long, document_fingerprint long, algo string, created_at long"
TYPES = dict(c.split() for c in SCHEMA.split(", "))
HASHES = ("prehash", "fullhash", "perceptual_hash", "document_fingerprint")
KEYS = ("path", "size", "mtime_ns")


def valid(size: Column, mtime: Column, inode: Column, cached_size: Column, cached_mtime: Column, cached_inode: Column) -> Column:
    """Size and time agree, and the inode where both are known."""
    return (size == cached_size) & (mtime == cached_mtime) & (inode.isNull() | cached_inode.isNull() | (inode == cached_inode))


def known(files: DataFrame, cache: DataFrame, *columns: str) -> DataFrame:
    """Adds ``_<column>`` as cached for (path, size, mtime_ns), null where it is not, for all
    columns by one join."""
    held = cache.filter(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull())
    held = held.select(*KEYS, *[F.col(c).alias(f"_{c}") for c in columns]).dropDuplicates(list(KEYS))
    return files.join(held, list(KEYS), "left")


def looked_up(files: DataFrame, cache: DataFrame, column: str) -> DataFrame:
    """Adds ``column`` as cached for (path, size, mtime_ns), null where it is not, and hit."""
    return known(files.drop(column), cache, column).withColumnRenamed(f"_{column}", column).withColumn("hit", F.col(column).isNotNull())


def full_entries(entries: DataFrame) -> DataFrame:
    """Entries with all columns of the cache, null where they bring none."""
    return entries.select(*[(F.col(n) if n in entries.columns else F.lit(None)).cast(t).alias(n) for n, t in TYPES.items()])


def merged(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache with ``entries`` in it, which has a row for each path at most (path, size, mtime_ns,
    inode, created_at and any of the hashes); the cache is read once.

    A prehash that comes without a full hash forgets it. Other hashes are added to what the row has
    if size and time are unchanged; else the row starts anew with those that come."""
    new = full_entries(entries).withColumn("_new", F.lit(True))
    old = cache.select(*[F.col(n).alias(f"_{n}") for n in TYPES])
    both = old.join(new, F.col("_path") == F.col("path"), "full")
    same = F.coalesce((F.col("size") == F.col("_size")) & (F.col("mtime_ns") == F.col("_mtime_ns")), F.lit(False))

    def value(n: str) -> Column:
        out = F.col(n)
        if n in HASHES or n == "algo":
            forgets = F.col("prehash").isNotNull() if n == "fullhash" else F.lit(False)
            out = F.coalesce(out, F.when(same & ~forgets, F.col(f"_{n}")))
        return F.when(F.col("_new"), out).otherwise(F.col(f"_{n}")).alias(n)

    return both.select(*map(value, TYPES))


def upsert(cache: DataFrame, entries: DataFrame, column: str) -> DataFrame:
    """The cache with one kind of hash merged in; of several entries of a path the newest counts."""
    new = entries.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("created_at"), F.desc("mtime_ns")))).filter("_n = 1")
    return merged(cache, new.select(*[c for c in new.columns if c in (*KEYS, "inode", "created_at", "algo", column)]))


def without(cache: DataFrame, paths: DataFrame) -> DataFrame:
    return cache.join(paths.select("path"), "path", "left_anti")


def prune_stale(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose file is still there."""
    return cache.join(files.select("path"), "path", "left_semi")


def prune_by_age(cache: DataFrame, now: int, age: int) -> DataFrame:
    """Rows made at now - age or later, in seconds."""
    return cache.filter(F.col("created_at") >= now - age)


#: Folders of paths by their hash.
BUCKETS = 32
_FOLDER = re.compile(r"(base|delta)=(\d+)-([0-9a-f]{12})(?:-(\d+))?")


@dataclass(frozen=True)
class _Part:
    kind: str
    number: int
    batch: int
    folder: str


class CacheLog:
    """A cache at ``path`` as a log of generations, with one writer at a time and any readers.

    ``delta`` folders hold the entries of one upsert each, a ``base`` folder what all generations up
    to its number come to. Inside, entries stand by bucket, a hash of the path, so folding goes
    bucket by bucket. A folder counts once it is whole. Readers take the newest base and the deltas
    after it; what those may read who came before the last base is not deleted before the next."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def parts(self) -> list[_Part]:
        """The whole generations, oldest first."""
        p, fs = self._fs()
        out = []
        for status in fs.listStatus(p) if fs.exists(p) else []:
            name = status.getPath().getName()
            found = _FOLDER.fullmatch(name)
            if found and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                out.append(_Part(found[1], int(found[2]), int(found[4] or -1), f"{self.path}/{name}"))
        return sorted(out, key=lambda x: (x.number, x.kind == "base", x.folder))

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def live(self) -> list[_Part]:
        """The newest base and the deltas after it."""
        parts = self.parts()
        bases = [x for x in parts if x.kind == "base"]
        return bases[-1:] + [x for x in parts if x.kind == "delta" and (not bases or x.number > bases[-1].number)]

    def _write(self, rows: DataFrame, kind: str, number: int, batch: int) -> None:
        bucket = F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")
        to = f"{self.path}/{kind}={number}-{uuid.uuid4().hex[:12]}" + (f"-{batch}" if batch >= 0 else "")
        rows.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(to, compression="zstd")

    def append(self, entries: DataFrame, batch: int = -1) -> None:
        """One more generation with ``entries`` (see ``merged``; of several for a path the newest
        counts). ``batch``: the number of the micro-batch of the one stream that writes here; one
        that is in the log already is not written again."""
        parts = self.parts()
        if batch >= 0 and any(x.batch == batch or x.kind == "base" and x.batch >= batch for x in parts):
            return
        newest = Window.partitionBy("path").orderBy(F.desc("created_at"), F.desc("mtime_ns"))
        rows = full_entries(entries).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
        self._write(rows, "delta", 1 + max((x.number for x in parts), default=-1), batch)

    def _entries(self, parts: list[_Part]) -> DataFrame:
        """All rows of generations with their number; one scan over all their folders."""
        if not parts:
            return self.spark.createDataFrame([], SCHEMA + ", bucket int, generation int")
        rows = self.spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(*[x.folder for x in parts])
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:base|delta)(?:=|%3D)(\d+)-", 1).cast("int")
        return rows.withColumn("generation", number).withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int"))

    def current(self) -> DataFrame:
        """The cache as a table (SCHEMA)."""
        return self._folded(self.live())

    def _folded(self, parts: list[_Part]) -> DataFrame:
        """What generations come to: as if each had been merged into those before it."""
        rows = self._entries(parts)
        if len(parts) < 2:
            return rows.select(*TYPES)
        of_path = Window.partitionBy("bucket", "path").orderBy(F.desc("generation"))
        first = lambda c: F.first(c).over(of_path.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        same = (F.col("size") == first("size")) & (F.col("mtime_ns") == first("mtime_ns"))
        upto = of_path.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("_same", F.min(F.coalesce(same, F.lit(False))).over(upto)).withColumn("_heads", F.max(F.col("prehash").isNotNull()).over(of_path.rowsBetween(Window.unboundedPreceding, -1)))
        rows = rows.filter("_same")  # back to where the file was another
        forgotten = F.coalesce(F.col("_heads"), F.lit(False))
        last = lambda n, value: F.max_by(value, F.when(value.isNotNull(), F.col("generation"))).alias(n)
        plain = [F.max_by(n, "generation").alias(n) for n in ("size", "mtime_ns", "inode", "created_at")]
        hashes = [last(n, F.when(~forgotten, F.col(n)) if n == "fullhash" else F.col(n)) for n in (*HASHES, "algo")]
        return rows.groupBy("bucket", "path").agg(*plain, *hashes).select(*TYPES)

    def known(self, files: DataFrame, *columns: str) -> DataFrame:
        """Adds ``_<column>`` as cached for (path, size, mtime_ns), as the function of that name; the
        log is read once for all columns."""
        return known(files, self.current(), *columns)

    def compact(self, keep=None) -> None:
        """Fold all generations into a new base, and delete those that only readers from before the
        last base could read. ``keep``: what of the cache stays, from a table to a table (see
        ``prune_stale`` and ``prune_by_age``)."""
        live, before = self.live(), [x for x in self.parts() if x.kind == "base"]
        if not live or live == before[-1:] and keep is None:
            return
        rows = self._folded(live)
        number = max(x.number for x in live) + (live == before[-1:])
        self._write(keep(rows) if keep else rows, "base", number, max(x.batch for x in live))
        if before:
            self._drop([x for x in self.parts() if x.number <= before[-1].number and x != before[-1]])

    def vacuum(self) -> None:
        """Delete all that a reader who begins now does not read."""
        live = self.live()
        self._drop([x for x in self.parts() if x not in live])

    def _drop(self, parts: list[_Part]) -> None:
        _, fs = self._fs()
        for x in parts:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(x.folder), True)
