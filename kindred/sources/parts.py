"""Documents and digests of any size, made by tasks.

The lines of a document are written by Spark, in parts that follow each other in the document's
order; what a failed or repeated task leaves is never seen. The parts are then joined to one file by
a copy that holds a buffer of them at a time, beside the target, which appears whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.plans.tables import discard, drop, materialize, scratch

#: Lines of a part, and digests that are hashed into one.
PART_ROWS, BRANCHES = 100_000, 256
BUFFER = 1 << 20


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any file system that Spark knows."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    found = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(found)).decode("utf-8")
    finally:
        found.close()


def write_document(lines: DataFrame, order: list[str], value: str, path: str, head: str = "", tail: str = "", rows: int | None = None) -> None:
    """Write ``head``, the lines of ``value`` in ``order``, each with a line end, and ``tail`` as one
    file, in place of one that is there. ``rows``: how many lines there are, if that is known."""
    spark = lines.sparkSession
    rows = lines.count() if rows is None else rows
    held = scratch(spark, "document")
    ordered = lines.select(*order, F.col(value).alias("_line")).repartitionByRange(1 + rows // PART_ROWS, *order).sortWithinPartitions(*order)
    target, fs = _path(spark, path)
    made, _ = _path(spark, f"{target.getParent().toString() if target.getParent() else '.'}/.{target.getName()}.{uuid.uuid4().hex}")
    try:
        ordered.select("_line").write.text(held)
        folder, from_fs = _path(spark, held)
        parts = sorted((s.getPath() for s in from_fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
        out = fs.create(made, True)
        try:
            out.write(bytearray(head.encode("utf-8")))
            for p in parts:
                part = from_fs.open(p)
                try:
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, BUFFER, False)
                finally:
                    part.close()
            out.write(bytearray(tail.encode("utf-8")))
        finally:
            out.close()
        fs.delete(target, False)
        if not fs.rename(made, target):
            raise OSError(f"{path} could not be written")
    finally:
        fs.delete(made, False)
        drop(held)


def folder_digest(spark: SparkSession, folder: str) -> str:
    """One SHA-256 over the data files of a folder: tasks hash a file each, and then digests by groups
    of about BRANCHES names, level by level, until one is left. Empty without files."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    level = materialize(files.select(name.alias("name"), F.sha2("content", 256).alias("digest")), "digests")
    while many := level.count():
        digits = 0
        while many > BRANCHES * 16**digits:
            digits += 1
        pairs = F.transform(F.array_sort(F.collect_list(F.struct("name", "digest"))), lambda x: F.concat(x["name"], F.lit("="), x["digest"]))
        groups = level.groupBy(F.substring(F.sha2("name", 256), 1, digits).alias("_g"))
        above = materialize(groups.agg(F.sha2(F.array_join(pairs, "\n"), 256).alias("digest")).select(F.col("_g").alias("name"), "digest"), "digests")
        discard(level)
        level = above
        if not digits:
            break
    found = level.first()
    discard(level)
    return found["digest"] if found else ""
