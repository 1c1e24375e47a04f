"""Content hashes, text fingerprints and perceptual hashes as columns."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.schema import PREHASH_BYTES

RUN_WORDS = 3


def prehash(content: Column, n: int = PREHASH_BYTES) -> Column:
    """Hash of the first ``n`` bytes. Never null: a nullable key would let the optimizer push the
    hashing of all rows below the joins that are there to avoid it."""
    return F.coalesce(F.sha2(F.substring(content, 1, n), 256), F.lit(""))


def fullhash(content: Column) -> Column:
    return F.coalesce(F.sha2(content, 256), F.lit(""))


def by_path(of) -> Column:
    """A column function of ``of(path, open file)`` over files that all executors can read: a struct
    of value and error, one of which is null. A null path gives nulls and opens nothing."""
    @F.pandas_udf("value string, error string")
    def read(paths: pd.Series) -> pd.DataFrame:
        out = []
        for p in paths:
            try:
                if p is None:
                    out.append((None, None))
                else:
                    with open(p, "rb") as f:
                        out.append((of(p, f), None))
            except OSError as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["value", "error"], dtype=object)

    return read


def file_prehash(path: Column, n: int = PREHASH_BYTES) -> Column:
    """The hash of a file's first ``n`` bytes, of which no more are read."""
    return by_path(lambda p, f: hashlib.sha256(f.read(n)).hexdigest())(path)


def file_hash(path: Column) -> Column:
    """The hash of a whole file, read through a buffer."""
    return by_path(lambda p, f: hashlib.file_digest(f, "sha256").hexdigest())(path)


def hex_digest(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def digest_of_hex(text: Column) -> Column:
    """The 32 bytes of 64 hex digits, else null."""
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.unhex(text))


def normalized(text: Column) -> Column:
    """Lower case without ASCII punctuation, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", ""), r"(?U)\s+", " "))


def with_shingles(df: DataFrame, text: str, out: str, n: int = RUN_WORDS) -> DataFrame:
    """Add runs of ``n`` words of normalized text; of fewer words each is a run; no words, no runs.
    The words are a column of their own, or they would be split again for every run."""
    words = F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.split(F.col(text), " "))
    w = f"_{out}_words"
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[F.get(F.col(w), i + j) for j in range(n)]))
    return df.withColumn(w, words).withColumn(out, F.when(F.size(w) < n, F.col(w)).otherwise(runs)).drop(w)


def simhash_of(text: str | None) -> int:
    """64 bits of normalized text: a bit is set where most runs' hashes have it. No words: 0."""
    words = text.split(" ") if text else []
    runs = list(map(" ".join, zip(*[words[i:] for i in range(RUN_WORDS)]))) or words
    if not runs:
        return 0
    raw = b"".join([hashlib.md5(r, usedforsecurity=False).digest()[:8] for r in map(str.encode, runs)])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    ones = 2 * bits.sum(axis=0, dtype=np.int64) > len(runs)
    return int.from_bytes(np.packbits(ones).tobytes(), "big", signed=True)


@F.pandas_udf(T.LongType())
def _simhash(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else simhash_of(t) for t in texts], dtype="Int64")


def simhash(text: Column) -> Column:
    """The fingerprint of a raw text, as a long whose bits count; null for null."""
    return _simhash(normalized(text))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def ahash(vector: Column) -> Column:
    """Bits: which components are above the mean."""
    v = vector.cast("array<double>")
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    return F.array_join(F.transform(v, lambda x: F.when(x > mean, "1").otherwise("0")), "")


def dhash(vector: Column) -> Column:
    """Bits: which components are below their right neighbour."""
    v = vector.cast("array<double>")
    bits = F.transform(F.sequence(F.lit(0), F.size(v) - 2), lambda i: F.when(F.get(v, i) < F.get(v, i + 1), "1").otherwise("0"))
    return F.when(F.size(v) < 2, "").otherwise(F.array_join(bits, ""))


@F.pandas_udf(T.StringType())
def phash(vectors: pd.Series) -> pd.Series:
    """Bits: which coefficients of the vector's cosine transform are above their median."""
    out = []
    for v in vectors:
        x = np.asarray(v, np.float64)
        n = len(x)
        c = (cosines(n) * x).sum(axis=1) if n else x
        out.append("".join("1" if b else "0" for b in c > np.median(c)) if n else "")
    return pd.Series(out, dtype=object)


def cosines(n: int) -> np.ndarray:
    """The matrix of the cosine transform of ``n`` values."""
    return np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * np.arange(n)[:, None] / (2 * n))


def image_bits(gray: np.ndarray, algorithm: str) -> int:
    """The 64-bit perceptual hash of a gray image (rows, columns), as a long: ahash marks cells above
    the mean, dhash cells below their right neighbour, phash coefficients of the lowest frequencies
    above their median."""
    from kindred.sources.images import resized

    if algorithm == "ahash":
        cells = resized(gray, 8, 8)
        on = cells > cells.mean()
    elif algorithm == "dhash":
        cells = resized(gray, 8, 9)
        on = cells[:, :-1] < cells[:, 1:]
    elif algorithm == "phash":
        c = cosines(32)
        low = (c @ resized(gray, 32, 32) @ c.T)[:8, :8]
        on = low > np.median(low)
    else:
        raise ValueError(f"no perceptual hash {algorithm!r}")
    return int.from_bytes(np.packbits(on.ravel()).tobytes(), "big", signed=True)


def bits_to_long(bits: Column) -> Column:
    """64 binary digits as a long with those bits."""
    high, low = (F.conv(F.substring(bits, at, 32), 2, 10).cast("long") for at in (1, 33))
    return F.shiftleft(high, 32).bitwiseOR(low)
