"""First-seen line stripping: lines that enough earlier documents had are cut out.

Documents come in batches. They are staged with their lines' keys, then a Structured Streaming
query is started for each batch on one checkpoint: it sums, by key, one for each document that
holds the key, and keeps the sums as its state. In update mode a batch is told the new sums of the
keys that it holds; foreachBatch takes the batch's own documents off, which leaves how many earlier
documents held a key, and joins the staged lines with the keys that had enough.

State, sums and joins are by the key's SHA-256, so long lines cost what short ones do. Keys that
hold more than a thousandth of a batch's lines, a thousand at most, are told to all tasks; all
others are joined by key, so no task meets the lines of a hot one."""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import drop, scratch

BATCHES, LEAST_CHARS, LEAST_DOCUMENTS = 10, 20, 2
#: Hot keys of a batch at most: each holds that share of the lines that matter, or more.
MOST_HOT, LEAST_HOT = 1000, 100
#: What the streaming queries run with: state on disk, of which a commit writes the changes.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store sets megabytes aside
    "spark.sql.streaming.stateStore.maintenanceInterval": "15s",
}
SPACE = " \t\n\v\f\r"
STAGED = "uid long, doc string, text string"


def batch_of(key: Column, batches: int = BATCHES) -> Column:
    """The batch of a document, 0 to batches - 1, by its number; of a null number the first."""
    return F.floor(batches * (F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 64) / 64).cast("int")


def lines_of(text: Column) -> Column:
    """The lines of a text; empty ones at its end count, and a null or empty text is one."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column, least_chars: int = LEAST_CHARS) -> Column:
    """SHA-256 of a line without white space at its ends, A to Z in lower case; null for short ones."""
    bare = F.translate(F.btrim(line, F.lit(SPACE)), ascii_uppercase, ascii_lowercase)
    return F.when(F.char_length(bare) >= least_chars, F.unhex(F.sha2(bare.cast("binary"), 256)))


@dataclass
class Stripped:
    """documents: key (as string, as given), batch, n_all and n_removed lines, kept (the text that
    is left). lines: key (SHA-256 of a line that was cut out somewhere), batch (the first), n_all
    (documents that hold it), n_removed (lines)."""

    documents: DataFrame
    lines: DataFrame


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _moved(spark: SparkSession, source: str, target: str) -> bool:
    """Whether there was a folder to move."""
    a, fs = _filesystem(spark, source)
    if not fs.exists(a):
        return False
    b, _ = _filesystem(spark, target)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{source} could not be moved to {target}")
    return True


def _held(docs: DataFrame, least_chars: int) -> DataFrame:
    """(key, documents): how many of ``docs`` (text) hold a key; one with several such lines counts
    once."""
    keys = F.array_distinct(F.transform(lines_of(F.col("text")), lambda x: key_of(x, least_chars)))
    return docs.select(F.explode(keys).alias("key")).filter("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("documents"))


class _Batch:
    """What foreachBatch does with the sums of one batch. A batch that is run again writes the same
    tables anew. Only the sums are read in the query's own session, which cannot adapt its plans."""

    def __init__(self, spark: SparkSession, staged: str, out: str, least_documents: int, least_chars: int):
        self.spark, self.staged, self.out, self.least, self.chars = spark, staged, out, least_documents, least_chars
        self.batch = 0

    def __call__(self, sums: DataFrame, number: int) -> None:
        spark, k = self.spark, self.batch
        at = f"{self.staged}/work/{k}"

        def written(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{at}/{name}", compression="zstd")
            return spark.read.schema(df.schema).parquet(f"{at}/{name}")

        # A key with enough earlier documents, and one here, has a larger sum than is enough.
        now = written(sums.filter(F.col("documents") > self.least), "sums")
        docs = spark.read.schema(STAGED).parquet(f"{self.staged}/in/{k}")
        own = _held(docs, self.chars).withColumnRenamed("documents", "own")
        known = written(now.join(own, "key").select("key", "documents", "own", (F.col("documents") - F.col("own") >= self.least).alias("gone")), "known")
        total = known.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]
        is_hot = F.col("own") >= max(LEAST_HOT, -(-total // MOST_HOT))
        hot = known.filter(is_hot).select("key", "gone")  # MOST_HOT rows at most
        lines = spark.read.schema("uid long, at int, key binary, batch int").parquet(f"{self.staged}/lines").filter(F.col("batch") == k)  # there may be none
        of_hot = lines.join(F.broadcast(hot.filter("gone").select("key")), "key", "left_semi")
        cold = known.filter(~is_hot).filter("gone").select("key")
        of_cold = lines.join(F.broadcast(hot.select("key")), "key", "left_anti").join(cold, "key", "left_semi")
        removed = written(of_hot.unionByName(of_cold).select("uid", "at", "key"), "removed")
        counts = removed.groupBy("key").agg(F.count(F.lit(1)).alias("lines")).join(known.select("key", "documents"), "key")
        counts.write.mode("overwrite").parquet(f"{self.out}/lines/batch={k}", compression="zstd")

        split = docs.select("uid", "doc", lines_of(F.col("text")).alias("lines"))
        ats = removed.groupBy("uid").agg(F.collect_list("at").alias("ats"))  # of one document each
        whole = split.join(ats, "uid", "left")
        n = F.size("lines")
        stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("ats"))
        kept = F.when(F.col("ats").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
        gone = F.when(F.col("ats").isNull(), 0).otherwise(F.size("ats"))
        told = whole.select("doc", n.cast("long").alias("n_all"), gone.cast("long").alias("n_removed"), kept.alias("kept"))
        told.write.mode("overwrite").parquet(f"{self.out}/documents/batch={k}", compression="zstd")
        p, fs = _filesystem(spark, at)
        fs.delete(p, True)


def strip_seen(docs: DataFrame, text: str = "text", key: str = "doc_id", batches: int = BATCHES, least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS) -> Stripped:
    """Cut out of each document the lines whose key ``least_documents`` documents of earlier batches
    held; see the module and ``Stripped``.

    Each row is a document, repeated rows and numbers too; null numbers stand in the first batch.
    A null or empty text is one empty line, which stays. Other columns are not looked at. Texts of
    any length are taken whole. An empty table, or a batch without rows, gives no rows and starts
    no query."""
    spark = docs.sparkSession
    base, out = scratch(spark, "stream"), scratch(spark, "stripped")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{key}`").cast("string").alias("doc"), F.col(f"`{text}`").alias("text"), batch_of(F.col(f"`{key}`"), batches).alias("batch"))
    rows.write.partitionBy("batch").parquet(f"{base}/hold", compression="zstd")  # from here on uid is fixed
    held = spark.read.schema(STAGED + ", batch int").parquet(f"{base}/hold")
    keys = F.transform(lines_of(F.col("text")), lambda x: key_of(x, least_chars))
    lines = held.select("uid", "batch", F.posexplode(keys).alias("at", "key")).filter("key IS NOT NULL")
    lines.write.partitionBy("batch").parquet(f"{base}/lines", compression="zstd")

    step, before = _Batch(spark, base, out, least_documents, least_chars), {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        for step.batch in range(batches):
            if _moved(spark, f"{base}/hold/batch={step.batch}", f"{base}/in/{step.batch}"):
                fed = spark.readStream.schema(STAGED).parquet(f"{base}/in/*")
                sums = _held(fed, least_chars).writeStream.outputMode("update").foreachBatch(step)
                sums.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    drop(base)

    def read(name: str, columns: str) -> DataFrame:
        path, fs = _filesystem(spark, f"{out}/{name}")
        return spark.read.schema(columns).parquet(f"{out}/{name}") if fs.exists(path) else spark.createDataFrame([], columns)

    documents = read("documents", "doc string, n_all long, n_removed long, kept string, batch int")
    gone = read("lines", "key binary, lines long, documents long, batch int")
    # A key that once lost lines loses them in each later batch that holds it: its last sum is whole.
    lines = gone.groupBy("key").agg(F.min("batch").alias("batch"), F.max("documents").alias("n_all"), F.sum("lines").alias("n_removed"))
    return Stripped(documents.withColumnRenamed("doc", "key"), lines)


def op13_seen_lines(spark, sf_dir: str) -> DataFrame:
    """All documents with what was cut out of them, then the lines that were cut out."""
    out = strip_seen(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    docs = out.documents.select(F.lit("doc").alias("row_kind"), F.col("key").alias("row_id"), "batch", "n_all", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    lines = out.lines.select(F.lit("line").alias("row_kind"), F.lower(F.hex("key")).alias("row_id"), "batch", "n_all", "n_removed", F.lit(None).cast("string").alias("kept_sha256"))
    return docs.unionByName(lines)


_STEP = "list_reduce(list_prepend(xor(c, b), range(8)::BIGINT[]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: {_STEP}), 4294967295)"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text, coalesce(10 * ({_CRC} % 64) // 64, 0) AS batch FROM documents),
l AS (SELECT uid, batch, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{ascii_uppercase}', '{ascii_lowercase}') AS key FROM l),
h AS (SELECT key, batch, count(DISTINCT uid) AS n FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key, batch),
s AS (SELECT key, batch, coalesce(sum(n) OVER (PARTITION BY key ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier, sum(n) OVER (PARTITION BY key) AS n_all FROM h),
r AS (SELECT k.*, s.n_all, coalesce(s.earlier >= {LEAST_DOCUMENTS}, false) AS gone FROM k LEFT JOIN s ON s.key = k.key AND s.batch = k.batch)
SELECT 'doc' AS row_kind, d.doc_id::VARCHAR AS row_id, d.batch::INT AS batch, count(*) AS n_all, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM r JOIN d ON d.uid = r.uid GROUP BY d.uid, d.doc_id, d.batch
UNION ALL SELECT 'line', sha256(key), min(batch)::INT, max(n_all)::BIGINT, count(*), NULL FROM r WHERE gone GROUP BY key"""
