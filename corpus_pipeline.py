"""A corpus pipeline of the llm operators: each stage's rows are the next one's documents.

All stages take the rows as they come: a null or empty text, a null in any other column, repeated
rows and very long texts are documents like others, and tables without rows stay so. Columns that
are named like one that an operator adds pass through untouched: operators see the columns under
other names. Ties are decided by hashes of the rows, so runs agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import materialize
from kindred.llm.langid import UNKNOWN, identify
from kindred.llm.mixing import mix
from kindred.llm.nearjoin import distinct_documents
from kindred.llm.packing import cut, place
from kindred.llm.quality import judged

#: A language that is less sure than this is rejected.
LEAST_SCORE = 0.3


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list]:
    """The documents under names that clash with nothing, the new names by the old ones, and the
    columns that bring the old ones back."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names, [F.col(n).alias(c) for c, n in names.items()]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Those without text or letters go, and those whose
    language is less sure than ``LEAST_SCORE``; equal texts go or stay together. If no document has
    a language, nothing can be told and all go."""
    held, n, back = _renamed(docs)
    known = identify(held, n["text"], n["lang"], n["doc_id"])
    return known.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*back)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are judged good by their text and site: source and language, where null is a
    value like others. Null and empty texts are judged by their shape, as bad as the labelled ones
    of that shape; without labels of both kinds all stay."""
    held, n, back = _renamed(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias(n["doc_id"]), "quality")
    return judged(held, labels, n["text"], n["doc_id"], n["source"], n["lang"]).filter("good = 1").select(*back)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that hangs together by n-gram similarity, repeated rows among
    them. Null and wordless texts are like nothing and stay."""
    return distinct_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, up to three times; a null source is a
    source. Documents without words are taken with their source's whole copies."""
    held, n, back = _renamed(docs)
    taken = mix(held, n["text"], n["source"], n["doc_id"])
    return taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*back)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences, a row for each piece: its document (doc_id, and row, which tells copies
    apart), its place in the document and in its sequence, and its ids as little-endian 32-bit
    numbers. A sequence is its pieces' ids in the order of offset. Null texts are empty: one piece
    with the end alone."""
    held, n, _ = _renamed(docs)
    pieces = cut(held.withColumn("row", F.monotonically_increasing_id()), n["text"], n["doc_id"], with_ids=True, row="row")
    return place(pieces).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset", "row", "ids")


STAGES = [
    ("language ID", language),
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources", mixture),
    ("best-fit packing", packed),
]

#: The first two stages are trained models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
