"""Language identification by hierarchical discrimination.

A text is a vector of hashed byte three-grams. Linear support vector machines first tell the
language's family from the others; within the family, one machine for each pair of languages
votes. Machines are trained on the driver from at most ``SAMPLE`` texts of each language and
``SAMPLE_ALL`` in all, so its memory is bounded however many languages there are; every text is
predicted from all of its bytes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import ship
from kindred.llm.linear import linear_svms, platt, sigmoid

BITS, SAMPLE, SAMPLE_ALL, UNKNOWN = 12, 500, 12_000, "und"

# Families by language code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "ur", "mr", "ne", "pa", "gu"),
    "iranian": ("fa", "ku", "ps"),
    "semitic": ("ar", "he", "am"),
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


def vectors(texts: list[str]) -> np.ndarray:
    """Unit vectors of the roots of hashed three-gram counts, in lower case."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for row, text in zip(out, texts):
        b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
        if len(b) > 2:
            h = ((b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
            row += np.sqrt(np.bincount(h, minlength=1 << BITS))
    return out / np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-9)[:, None]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Machine:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    @classmethod
    def fit(cls, x: np.ndarray, yes: np.ndarray) -> list[Machine]:
        """A machine for each column of ``yes``, all trained together."""
        weight = np.where(yes, 0.5 / np.maximum(1, yes.sum(axis=0)), 0.5 / np.maximum(1, (~yes).sum(axis=0)))
        w, b = linear_svms(x, np.where(yes, 1.0, -1.0).astype(np.float32), weight.astype(np.float32))
        margin = x @ w + b
        return [cls(w[:, k].astype(np.float32), float(b[k]), *platt(margin[:, k], yes[:, k].astype(float))) for k in range(yes.shape[1])]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * (x @ self.weights + self.bias) + self.shift)


@dataclass
class Model:
    """families: languages of each; of_family: a machine for each, against the rest;
    pairs: by family, a machine for each pair of its languages, for the first of the two."""

    families: dict[str, list[str]] = field(default_factory=dict)
    of_family: dict[str, Machine] = field(default_factory=dict)
    pairs: dict[str, dict[tuple[str, str], Machine]] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, lang: np.ndarray) -> Model:
        model = cls()
        for code in sorted(set(lang)):
            model.families.setdefault(FAMILY.get(code, f"of {code}"), []).append(code)
        family, names = np.array([FAMILY.get(c, f"of {c}") for c in lang]), list(model.families)
        if len(names) > 1:
            model.of_family = dict(zip(names, Machine.fit(x, family[:, None] == np.array(names))))
        for name, codes in model.families.items():
            model.pairs[name] = {(a, b): Machine.fit(x[on := (lang == a) | (lang == b)], lang[on, None] == a)[0] for a, b in combinations(codes, 2)}
        return model

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores: the family's probability among families times the language's
        share of the probabilities that its pairs give. No letters: unknown, 0."""
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = np.array([i for i, t in enumerate(texts) if has_letter(t)], int)
        names = list(self.families)
        if not names or not len(at):
            return langs, scores
        x = vectors([texts[i] for i in at])
        p = np.stack([self.of_family[n](x) if self.of_family else np.ones(len(x)) for n in names], axis=1)
        first = p.argmax(axis=1)
        sure = p.max(axis=1) / np.maximum(p.sum(axis=1), 1e-12)
        for k, name in enumerate(names):
            rows, codes = np.flatnonzero(first == k), self.families[name]
            share = np.ones((len(rows), len(codes)))
            for (a, b), machine in self.pairs[name].items():
                q = machine(x[rows])
                share[:, codes.index(a)] *= q
                share[:, codes.index(b)] *= 1 - q
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-12)
            for r, s in zip(rows, share):
                langs[at[r]] = codes[int(s.argmax())]
                scores[at[r]] = sure[r] * s.max()
        return langs, np.clip(scores, 0, 1)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Learn from rows with a language and a letter, at most ``sample`` of each language, and fewer
    where there are so many languages that all would be over ``SAMPLE_ALL``. The rows of the least
    hashes of key and text are taken, so every run learns from the same; every language that has
    such a row is learned."""
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{key}`").alias("key")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return Model()
    sample = max(1, min(sample, SAMPLE_ALL // len(counts)))
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], (1.25 * sample + 40) / r["count"])])
    some = rows.withColumn("h", F.xxhash64("key", "text")).filter(F.pmod("h", F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "key"))  # about 1.25 * sample + 40 rows of a language
    some = some.withColumn("n", place).filter(F.col("n") <= 2 * sample + 80).drop("n")

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([vectors([t])[0].astype(np.float16).tobytes() if has_letter(t) else None for t in texts])

    taken: dict[str, int] = {}
    picked, langs = [], []
    for r in some.select("lang", packed("text").alias("x"), "h").orderBy("h", "lang").toLocalIterator():
        if r["x"] is not None and taken.get(r["lang"], 0) < sample:
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
            picked.append(np.frombuffer(bytes(r["x"]), np.float16))
            langs.append(r["lang"])
    if not picked:
        return Model()
    x = np.empty((len(picked), 1 << BITS), np.float32)
    for i, row in enumerate(x):
        row[:], picked[i] = picked[i], None
    return Model.fit(x, np.array(langs))


def predicted(model: Model, spark, text: Column) -> Column:
    """A column struct<lang, score> for the texts."""
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = [sent.value.predict(list(texts[i : i + 256])) for i in range(0, len(texts), 256)]
        return pd.DataFrame({"lang": [x for langs, _ in out for x in langs], "score": np.concatenate([s for _, s in out] or [np.zeros(0)])})

    return of(text)


def held_out(key: Column, of: int, part: int) -> Column:
    """Whether the CRC-32 of the key, as text, leaves ``part`` when divided by ``of``; no key: no."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(of)) == part, F.lit(False))


def identify(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Add held_out, lang_pred and score to every row; input columns of these names are replaced.

    Learns from the rows that are not held out. A null text or one without letters is ``und`` with
    score 0, and so is every text if no row has a language. Equal texts, and so repeated rows, get
    equal predictions; texts of any length are read whole; an empty table stays empty."""
    spark = df.sparkSession
    out = held_out(F.col(f"`{key}`"), 3, 1)
    model = fit(df.filter(~out & F.col(f"`{key}`").isNotNull()), text, lang, key)
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("held_out", "lang_pred", "score", "_p")]
    return df.select(*keep, out.alias("held_out"), predicted(model, spark, F.col(f"`{text}`")).alias("_p")).withColumn("lang_pred", F.col("_p.lang")).withColumn("score", F.col("_p.score")).drop("_p")


def op6_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every document; a third of the documents is not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs.select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")
