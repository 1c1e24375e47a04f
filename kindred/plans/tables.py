"""Intermediate tables that survive lost executors, and joins that only broadcast what is small."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.schema import BROADCAST_BYTES

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Where none is named, a temporary folder is made and set, but only if the executors run inside
    the driver; on a cluster they would write to disks of their own, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kindred-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared one, for what an operator writes there itself. It goes with
    ``drop``, or when the driver's Python ends."""
    path = f"{shared_dir(spark)}/kindred/{uuid.uuid4().hex}/{tag}"
    _written[path] = spark
    return path


def drop(*paths: str) -> None:
    """Delete folders of ``scratch`` that nothing reads any more."""
    for p in paths:
        if p in _written:
            _drop(p)


#: Rows of a file, where their number is about known.
FILE_ROWS = 50_000


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a cut of the lineage that
    survives lost executors. The table goes with ``discard``, or when the driver's Python ends.

    ``rows``: about how many there are, so that a short table is not written as many files."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(1 + rows // FILE_ROWS)
    path = scratch(spark, tag)
    df.write.parquet(path, compression="zstd")  # its buffers do not stay behind outside the heap
    out = spark.read.schema(df.schema).parquet(path)
    out._kindred_path = path
    return out


def _drop(path: str) -> None:
    spark = _written.pop(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more: neither a plan that is still to run nor
    the lineage of one that may have to run again."""
    drop(*[t._kindred_path for t in tables if hasattr(t, "_kindred_path")])


@atexit.register
def _drop_written() -> None:
    for path in list(_written):
        try:
            _drop(path)
        except Exception:  # noqa: BLE001, S112  the session may be gone, and with it the way to its store
            continue


def size_of(df: DataFrame) -> int:
    """Bytes of the rows of ``df``: strings and binaries as long as they are, eight for each other
    column, which must be flat."""
    wide = [c for c in df.schema if isinstance(c.dataType, (T.StringType, T.BinaryType))]
    flat = 16 + 8 * len(df.columns)
    lengths = [F.coalesce(F.sum(F.octet_length(f"`{c.name}`")), F.lit(0)) for c in wide]
    n, *rest = df.agg(F.count(F.lit(1)), *lengths).first()
    return n * flat + sum(rest)


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked to go to every task if its bytes, which are counted, are at most ``most``;
    beyond that joins shuffle."""
    return F.broadcast(df) if size_of(df) <= most else df


def keep_in(df: DataFrame, keys: DataFrame, on: list[str], most: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of ``df`` whose ``on`` values are in ``keys``: a short list goes to every task, so that
    wide rows of ``df`` stay where they are; a long one is shuffled to."""
    return df.join(bounded(keys.select(*on), most), on, "left_semi")


#: Bytes of an input, as the plan knows them, that are dealt out anew.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores, where a small input comes in fewer parts than there are cores (one
    file of one row group). An input of over ``SPREAD_BYTES`` stays where it is read, in however
    many parts, so wide rows are never moved in bulk."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    bytes_ = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if bytes_ <= SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df
