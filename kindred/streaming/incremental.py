"""Incremental scans: a stream of file rows keeps the hash cache up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.functions.hashing import fullhash, prehash
from kindred.sources.cache import CacheLog

#: Generations after which the log is folded.
FOLD_AFTER = 20


def hash_stream(files: DataFrame, log: CacheLog, checkpoint: str, fold_after: int = FOLD_AFTER) -> StreamingQuery:
    """From a stream of (path, size, mtime_ns, inode, created_at, content): each micro-batch writes
    its own entries as a generation of the log, named by the batch, so a batch that is run again
    replaces itself. Every ``fold_after`` generations the log is folded, and those go that nothing
    reads any more."""
    def merge(batch: DataFrame, number: int) -> None:
        seen = batch.withColumn("prehash", prehash(F.col("content"))).withColumn("fullhash", fullhash(F.col("content")))
        log.append(seen.drop("content"), number)
        if sum(x.kind == "delta" for x in log.live()) >= fold_after:
            log.compact()

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
