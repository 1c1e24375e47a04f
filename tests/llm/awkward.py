"""Documents with every awkward case, and columns whose names clash with what operators add."""

LONG = "palavra longa demais para caber numa linha só " * 4000
ROWS = [
    (0, "plain words of a first document that stands alone here", "en", "a"),
    (1, None, "en", "a"),
    (2, "", None, "b"),
    (3, " \n\t ", "de", None),
    (4, LONG, "es", "a"),
    (5, "same text of some words, twice in the table as two documents", "en", "b"),
    (6, "same text of some words, twice in the table as two documents", "en", "b"),
    (7, "a row that is there three times, whole", "en", "c"),
    (7, "a row that is there three times, whole", "en", "c"),
    (7, "a row that is there three times, whole", "en", "c"),
    (None, "a document without a number", "en", None),
    (8, "12 34 -- !!", "fr", "a"),
    (9, "é", "fr", "a"),
    (9, "the number nine again, with another text", None, "c"),
]
CLASH = ("size", "shard", "slot", "score", "uid", "key", "label", "copies", "bound", "h", "sig", "_uid", "held_out", "evidence", "good", "stays", "block", "host", "path")


def documents(spark, rows=ROWS, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"x{c}").alias(c) for c in CLASH]) if clash else df


def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(9)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
