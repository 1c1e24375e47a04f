"""Toxicity scores from a factorization machine over hashed terms.

A text's terms are its words and the words' first four and five letters, hashed. On a bounded
sample of labelled texts a factorization machine learns a weight and a short vector for each term
of two texts or more: the product of two vectors is the weight of seeing both terms, so an insult
and the mention of a group can count for more together than apart, even where neither tells
anything alone. A score reads all words of the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import ship
from kindred.llm.langid import held_out
from kindred.llm.linear import sigmoid
from kindred.plans.tables import spread

BITS, FIRST, RANK, PREFIXES = 20, 1024, 8, (4, 5)
#: Labelled texts that are learned from, of either label.
SAMPLE = 3000
#: Terms of more than one in so many texts are held as dense columns when learning; speed only.
DENSE = 64
#: Distinct words whose terms a model keeps at hand.
WORDS_KEPT = 200_000
#: Texts that are scored together.
TEXTS = 64
LETTERS = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[int]:
    mask = (1 << BITS) - 1
    return [xxhash.xxh32_intdigest(word) & mask, *(xxhash.xxh32_intdigest(word[:n], n) & mask for n in PREFIXES if len(word) > n)]


def words_of(text: str | None) -> set[str]:
    return set(LETTERS.findall((text or "").lower()))


@dataclass
class Machine:
    """columns: by term, its place in weights and vectors."""

    bias: float
    columns: dict[int, int]
    weights: np.ndarray
    vectors: np.ndarray

    def __post_init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def places(self, word: str) -> tuple[int, ...]:
        out = tuple(self.columns[t] for t in terms_of(word) if t in self.columns)
        if len(self.known) < WORDS_KEPT and len(word) < 40:
            self.known[word] = out
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The texts' sparse rows, end to end, times weights and vectors at once. A text without a
        known term has the bias alone."""
        known, rows = self.known, []
        for text in texts:
            on: set[int] = set()
            for w in words_of(text):
                places = known.get(w)
                if places is None:
                    places = self.places(w)
                on.update(places)
            rows.append(sorted(on))
        sizes = np.array([len(r) for r in rows], int)
        at, some = np.fromiter(chain.from_iterable(rows), np.intp, sizes.sum()), np.flatnonzero(sizes)
        out = np.full(len(rows), float(self.bias))
        if len(some):
            starts = np.cumsum(sizes)[some] - sizes[some]
            v = self.vectors[at]
            sums, squares = (np.add.reduceat(x, starts, axis=0) for x in (v, v**2))
            out[some] += np.add.reduceat(self.weights[at], starts) + 0.5 * (sums**2 - squares).sum(axis=1)
        return sigmoid(out)


def chosen(sets: list[np.ndarray], y: np.ndarray, most: int = FIRST) -> np.ndarray:
    """The terms that are learned first: those with the largest chi-square against the label, of those in three texts or more."""
    terms, at = np.unique(np.concatenate(sets) if sets else np.zeros(0, int), return_inverse=True)
    label = np.repeat(y, [len(s) for s in sets])
    a, seen = np.bincount(at, label, len(terms)), np.bincount(at, minlength=len(terms))
    n, yes = len(y), y.sum()
    b, c = seen - a, yes - a
    d = n - yes - b
    chi = n * (a * d - b * c) ** 2 / np.maximum(seen * (n - seen) * yes * (n - yes), 1e-9)
    chi[seen < 3] = 0
    best = np.lexsort((terms, -chi))[:most]
    return np.sort(terms[best[chi[best] > 3.84]])


class Incidence:
    """Which text has which term, as a matrix of texts by terms: dense columns of frequent terms,
    runs of places for the others. ``terms``: those of two texts or more that not all texts have."""

    def __init__(self, sets: list[np.ndarray]):
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        terms, at, seen = np.unique(np.concatenate(sets) if sets else np.zeros(0, int), return_inverse=True, return_counts=True)
        often = (seen > len(sets) / DENSE)[at]
        kept = ((seen > 1) & (seen < len(sets)))[at]
        columns = np.r_[np.unique(at[kept & often]), np.unique(at[kept & ~often])].astype(int)
        place = np.zeros(len(terms), int)
        place[columns] = np.arange(len(columns))
        self.terms, self.n = terms[columns], len(sets)
        self.dense = np.zeros((self.n, len(np.unique(at[kept & often]))), np.float32)
        self.dense[rows[kept & often], place[at[kept & often]]] = 1
        rows, columns = rows[kept & ~often], place[at[kept & ~often]] - self.dense.shape[1]
        self.by_row = columns, *np.unique(rows, return_index=True)
        order = np.argsort(columns, kind="stable")
        self.by_column = rows[order], np.unique(columns[order], return_index=True)[1]

    def dot(self, v: np.ndarray) -> np.ndarray:
        """Sums of the rows of ``v`` over each text's terms."""
        k = self.dense.shape[1]
        out = self.dense @ v[:k]
        columns, rows, starts = self.by_row
        if len(columns):
            out[rows] += run_sums(v[k:], columns, starts)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        """Sums of the rows of ``g`` over each term's texts."""
        rows, starts = self.by_column
        rare = run_sums(g, rows, starts) if len(rows) else g[:0]
        return np.concatenate([self.dense.T @ g, rare])


def run_sums(v: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``v[at]`` over the runs that begin at ``starts``, by columns, which keeps reads together."""
    out, held = np.empty((v.shape[1], len(starts)), v.dtype), np.empty(len(at), v.dtype)
    for column, sums in zip(np.ascontiguousarray(v.T), out):
        np.add.reduceat(np.take(column, at, out=held, mode="clip"), starts, out=sums)
    return out.T


def learn(sets: list[np.ndarray], y: np.ndarray, rate: float, rounds: int = 200, joined: int = 60, l2: float = 2e-4, step: float = 0.05, slow: float = 0.05) -> Machine:
    """Fit on the whole sample: by Adam the terms that tell most alone, then all others on what is
    left to tell, each in proportion to its gradient. ``rate``: the share of label 1 that the bias
    is set for."""
    x = Incidence(sets)
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32)
    vectors = np.random.default_rng(7).normal(0, 0.01, (len(x.terms), RANK)).astype(np.float32)
    early = np.isin(x.terms, chosen(sets, y))
    some = Incidence([np.intersect1d(s, x.terms[early], assume_unique=True) for s in sets])
    at = np.argsort(x.terms)[np.searchsorted(np.sort(x.terms), some.terms)]

    def gradients(x: Incidence, bias: np.ndarray, w: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
        sums = x.dot(np.c_[w, v, (v**2).sum(axis=1)])
        xv = sums[:, 1:-1]
        f = bias[0] + sums[:, 0] + 0.5 * ((xv**2).sum(axis=1) - sums[:, -1])
        g = weight * (sigmoid(f) - y).astype(np.float32)
        back = x.back(np.c_[g, g[:, None] * xv])
        return [np.array([g.sum()], np.float32), back[:, 0] + l2 * w, back[:, 1:] - v * back[:, :1] + l2 * v]

    params = [np.zeros(1, np.float32), np.zeros(len(at), np.float32), vectors[at]]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        for p, m, s, d in zip(params, first, second, gradients(some, *params)):
            m += 0.1 * (d - m)
            s += 0.001 * (d * d - s)
            p -= step * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    bias, w, v = params[0], np.zeros(len(x.terms), np.float32), np.float32(0.1) * vectors
    w[at], v[at] = params[1:]
    late = ~early
    first, most = [np.zeros_like(p) for p in (bias, w[late], v[late])], [1e-8] * 3
    for t in range(1, joined + 1):
        grads = gradients(x, bias, w, v)
        for k, (p, on, d) in enumerate(zip((bias, w, v), (slice(None), late, late), grads)):
            first[k] += 0.1 * (d[on] - first[k])
            most[k] = max(most[k], float(np.abs(d[on]).max(initial=0)))
            p[on] -= np.float32(slow / (1 - 0.9**t) / most[k]) * first[k]
    prior = np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
    return Machine(float(bias[0] + min(0.0, prior)), {int(t): i for i, t in enumerate(x.terms)}, w.astype(float), v.astype(float))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Learn from rows of ``labels`` with a label of 0 or 1, joined to their texts by key: at most
    ``sample`` of either, those of the least hashes of key and text, so every run learns from the
    same rows. Without labels of both kinds every score is 0."""
    ship(docs.sparkSession)
    marked = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("y")).filter("key IS NOT NULL AND y IN (0, 1)")
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if len(counts) < 2:
        return Machine(-50.0, {}, np.zeros(0), np.zeros((0, RANK)))
    share = F.when(F.col("y") == 1, min(1.0, 1.1 * sample / counts[1])).otherwise(min(1.0, 1.1 * sample / counts[0]))
    some = marked.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share * (1 << 20)).orderBy(F.xxhash64("key"), "key", "y").limit(3 * sample)

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        sets, terms = [words_of(x) for x in texts], {}
        for w in set().union(*sets):
            terms[w] = terms_of(w)
        return pd.Series([np.array(sorted(set().union(*map(terms.__getitem__, s))), np.int32).tobytes() for s in sets])

    rows = spread(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("text"))).join(F.broadcast(some), F.col("_key") == F.col("key"))  # at most 3 * sample rows
    packs = rows.select("y", packed("text").alias("x"), F.xxhash64("key").alias("h"), F.xxhash64("text").alias("t"))
    found = packs.orderBy("h", "t", "y").limit(4 * sample).collect()
    picked = [r for label in (0, 1) for r in [r for r in found if r["y"] == label][:sample]]
    y = np.array([r["y"] for r in picked], float)
    if not len(y) or y.min() == y.max():
        return Machine(-50.0, {}, np.zeros(0), np.zeros((0, RANK)))
    return learn([np.frombuffer(r["x"], np.int32).astype(int) for r in picked], y, counts[1] / (counts[0] + counts[1]))


def scored(model: Machine, spark, text: Column) -> Column:
    """A column with the score of each text, 0 to 1."""
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        parts = [sent.value.scores(list(texts[i : i + TEXTS])) for i in range(0, len(texts), TEXTS)]
        return pd.Series(np.concatenate([*parts, np.zeros(0)]))

    return of(text)


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Add held_out, score and predicted to every row; input columns of these names are replaced.

    Rows that are held out are not learned from. Null, empty and unknown texts have no terms and
    get the bias alone. Equal texts, and so repeated rows, get equal scores; texts of any length
    are read whole; an empty table stays empty; without labels of both kinds every score is 0."""
    out = held_out(F.col(f"`{key}`"), 5, 0)
    model = fit(docs, labels.filter(~held_out(F.col(f"`{key}`"), 5, 0)), text, key)
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "score", "predicted")]
    scores = spread(docs).select(*keep, out.alias("held_out"), scored(model, docs.sparkSession, F.col(f"`{text}`")).alias("score"))
    return scores.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document; a fifth of the documents is not learned from."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")).select("doc_id", "held_out", "score", "predicted")
