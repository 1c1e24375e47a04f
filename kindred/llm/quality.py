"""Quality classification by hierarchical empirical Bayes.

A logistic model of a text's shape gives each document its own evidence. Documents stand on paths
and paths on hosts; a host's rate of good documents is the mean of their evidence, shrunk toward
the global rate, and a path's is shrunk toward its host's. How strongly follows from the spread of
the rates around their parents' (moments of the grouped counts), so sparse sites lean on their
parents and large ones on themselves. The path's posterior is the prior odds under which a
document's evidence is read. It is taken without the document itself, whose evidence would else
count twice: a document alone on its site has the global rate as prior.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import bounded, materialize, ship
from kindred.llm.linear import logistic, sigmoid

#: Labelled texts that are learned from, of either label.
SAMPLE = 3000
#: Bounds of the prior's strength, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 4.0, 1000.0
THRESHOLD = 0.5
COMMON = frozenset(b".,;:?'\"()-")


def shape(text: str | None) -> np.ndarray:
    """Features of the whole text; null counts as empty."""
    text = text or ""
    words = text.split()
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n, w = max(1, len(raw)), max(1, len(words))
    counts = np.bincount(raw, minlength=256)
    upper, lower = counts[65:91].sum(), counts[97:123].sum() + counts[128:].sum() / 2
    symbols = sum(int(counts[c]) for c in range(33, 127) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c in COMMON))
    again = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    return np.array([
        upper / max(1.0, upper + lower),
        symbols / n,
        min(1.0, symbols / w),
        counts[ord("!")] / w,
        counts[ord("|")] / w,
        counts[48:58].sum() / n,
        again / w,
        len(set(words)) / w,
        np.log1p(w),
        min(20.0, n / w) / 20,
        sum(x.isupper() for x in words) / w,
        (counts[ord(".")] + counts[ord("?")]) / w,
        1 - len(set(lines)) / max(1, len(lines)),
        float(not words),
    ])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return sigmoid(expanded(z) @ self.weights + self.bias)


def expanded(z: np.ndarray) -> np.ndarray:
    """The features, and those that only show in excess, at their roots."""
    return np.c_[z, np.sqrt(np.abs(z)) * np.sign(z)]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Model | None:
    """Learn from rows of ``labels`` with a label of 0 or 1, joined to their texts by key: at most
    ``sample`` of either, those of the least hashes of key and text, so every run learns from the
    same rows. None without labels of both kinds."""
    ship(docs.sparkSession)
    marked = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("y")).filter("key IS NOT NULL AND y IN (0, 1)")
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("y") == 1, min(1.0, 1.1 * sample / counts[1])).otherwise(min(1.0, 1.1 * sample / counts[0]))
    some = marked.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share * (1 << 20)).orderBy(F.xxhash64("key"), "key", "y").limit(3 * sample)

    @F.pandas_udf("array<double>")
    def shapes(texts: pd.Series) -> pd.Series:
        return pd.Series([shape(t) for t in texts])

    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("text")).join(F.broadcast(some), F.col("_key") == F.col("key"))  # at most 3 * sample rows
    shaped = rows.select("y", shapes("text").alias("x"), F.xxhash64("key").alias("h"), F.xxhash64("text").alias("t"))
    found = shaped.orderBy("h", "t", "y").limit(4 * sample).collect()
    picked = [r for y in (0, 1) for r in [r for r in found if r["y"] == y][:sample]]
    y = np.array([r["y"] for r in picked], float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array([r["x"] for r in picked])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    w, b = logistic(expanded(np.clip((x - mean) / scale, -6, 6)), y)
    sampled, rate = y.mean(), counts[1] / (counts[0] + counts[1])
    return Model(mean, scale, w, b + np.log(rate / (1 - rate)) - np.log(sampled / (1 - sampled)))


def evidence(model: Model | None, spark, text: Column) -> Column:
    """A column with the probability that a text by itself is good; one half without a model."""
    ship(spark)
    if model is None:
        return F.lit(0.5)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value(np.stack([shape(t) for t in texts])) if len(texts) else [], dtype=float)

    return of(text)


def _strength(groups: DataFrame) -> float:
    """How many documents the prior of these groups (n, good, center) is worth: by the method of
    moments, from how far the groups' rates spread around their centers, the parents' rates, beyond
    what their sizes explain."""
    rate = F.col("good") / F.col("n")
    within = F.col("center") * (1 - F.col("center"))
    total, between, inside, many = groups.agg(F.sum("n"), F.sum(F.col("n") * F.pow(rate - F.col("center"), 2)), F.sum(F.col("n") * within), F.count(F.lit(1))).first()
    if not total or many < 2 or not inside:
        return MOST_STRENGTH
    mean = inside / total
    variance = (between - many * mean) / max(1e-9, total)
    return MOST_STRENGTH if variance <= 0 else float(np.clip(mean / variance - 1, LEAST_STRENGTH, MOST_STRENGTH))


def posteriors(rows: DataFrame) -> DataFrame:
    """From rows (host, path, evidence): for each path the sums of its host and its own (host_n,
    host_good, n, good), the strengths of both priors and the global rate; ``prior`` makes a
    document's posteriors of them. Sums are taken by path before anything is shuffled, so a hot host
    is a few rows; a null host or path is a site like any other."""
    paths = materialize(rows.groupBy("host", "path").agg(F.sum("evidence").alias("good"), F.count(F.lit(1)).alias("n")), "paths")
    hosts = paths.groupBy(F.col("host").alias("_host")).agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    good, n = paths.agg(F.sum("good"), F.sum("n")).first()
    rate = min(max(good / n, 1e-4), 1 - 1e-4) if n else 0.5
    strong = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_good").alias("good"), F.lit(rate).alias("center")))
    out = paths.join(hosts, paths["host"].eqNullSafe(hosts["_host"])).drop("_host")
    out = materialize(out, "sites")
    strong_path = _strength(out.withColumn("center", (F.col("host_good") + strong * rate) / (F.col("host_n") + strong)))
    return out.select("*", F.lit(strong).alias("host_strength"), F.lit(strong_path).alias("path_strength"), F.lit(rate).alias("rate"))


def prior(evidence: Column) -> tuple[Column, Column]:
    """The posteriors of a document's host and path, from the columns of ``posteriors``, without
    the document's own evidence."""
    host = (F.col("host_good") - evidence + F.col("host_strength") * F.col("rate")) / (F.col("host_n") - 1 + F.col("host_strength"))
    path = (F.col("good") - evidence + F.col("path_strength") * host) / (F.col("n") - 1 + F.col("path_strength"))
    return host, path


def site_of(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL: the host in lower case without port, www. and m.; the first folder,
    or / where the page stands right on the host. Null for a null URL; a text without a host is on
    the empty host."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/:]*)", 1)), r"^(www|m)\.", "")
    return host, F.concat(F.lit("/"), F.regexp_extract(bare, r"^[^/]*/([^/]+)/", 1))


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", path: str = "lang") -> DataFrame:
    """Add evidence, host_posterior, path_posterior, quality_score and good (0 or 1) to every row;
    input columns of these names are replaced. Null and empty texts are read as their shape says,
    texts of any length whole; repeated rows are documents of their own; an empty table stays
    empty; without labels of both kinds all documents score as their sites."""
    added = ("evidence", "host_posterior", "path_posterior", "quality_score", "good")
    keep = [c for c in docs.columns if c not in added]
    model = fit(docs, labels, text, key)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{host}`").alias("host"), F.col(f"`{path}`").alias("path"), evidence(model, docs.sparkSession, F.col(f"`{text}`")).alias("evidence"))
    rows = materialize(rows, "evidence")
    site = bounded(posteriors(rows.select("host", "path", "evidence")).withColumnsRenamed({"host": "_host", "path": "_path"}))
    of_host, of_path = prior(F.col("evidence"))
    odds = lambda p: F.log(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))
    score = 1 / (1 + F.exp(-(odds(F.col("evidence")) + odds(F.col("path_posterior")) - odds(F.col("rate")))))
    out = rows.join(site, rows["host"].eqNullSafe(site["_host"]) & rows["path"].eqNullSafe(site["_path"]))
    out = out.withColumn("host_posterior", of_host).withColumn("path_posterior", of_path)
    out = out.withColumn("quality_score", score).withColumn("good", (F.col("quality_score") >= THRESHOLD).cast("int"))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *added)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """The quality of every document, with its source as host and its language there as path."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = judged(docs.select("doc_id", "text", "source", "lang"), labels.select("doc_id", "quality"))
    return rows.select("doc_id", "evidence", "host_posterior", "path_posterior", "quality_score", "good")
