"""Quality rules that hear a document's host.

Each text is counted once (words, symbols, repeated lines and runs). What fails a base rule goes.
Softer rules alone drop nothing: how often documents of a host fail each of them is summed by host
and shrunk by a beta prior, whose mean is the rate of all documents and whose strength follows from
how far the hosts' rates spread beyond what their sizes explain. A host is suspect for a rule that
its documents fail far more often than others, and there the rule counts; a host nearly all of
whose documents fail something is rejected whole. Verdicts are joined back to the documents."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import bounded, materialize, ship

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOLS, SPACES = b"#*$%&|<>", " \t\n\v\f\r"
WINDOW = 3
LEAST_WORDS, MOST_REPEATED = 50, 50
#: The softer rules, by column of their failures: as SQL conditions over the counts.
RULES = {
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
    "repetition": "100 * n_repeat_words > 25 * n_words",
}
BASE = f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"
#: A host is suspect for a rule if its shrunken rate is over this and over twice the rate of all,
#: and rejected if more than that share of its documents, shrunken too, fail anything.
LEAST_SUSPECT, TIMES_ALL, REJECTED = 0.1, 2.0, 0.8
#: Bounds of the prior's strength, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 4.0, 1000.0


def counted(text: str | None) -> tuple[int, ...]:
    """COUNTS of a whole text; null counts as empty. Words are runs without ASCII white space, which
    is what bytes are split at."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    seen, repeated = Counter(windows), 0
    if len(seen) < len(windows):
        again = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
        inside = np.zeros(n, bool)
        for i in range(WINDOW):
            inside[i : i + len(again)] |= again
        repeated = int(inside.sum())
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(raw.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated


def with_counts(docs: DataFrame, text: Column) -> DataFrame:
    """Adds a struct ``counts`` of COUNTS."""
    ship(docs.sparkSession)

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counted(t) for t in texts], columns=list(COUNTS), dtype="int64")

    return docs.withColumn("counts", of(text))


def host_verdicts(rows: DataFrame) -> DataFrame:
    """From rows (host, failed: struct of 0 or 1 by rule and ``any``): (host, documents, rates: the
    shrunken rate by rule, rejected, suspect: whether the rule counts, by rule). Sums are taken
    before anything is shuffled, so a hot host is a row a task; a null host is a host."""
    names = [*RULES, "any"]
    hosts = materialize(rows.groupBy("host").agg(F.count(F.lit(1)).alias("documents"), *[F.sum(f"failed.{r}").alias(r) for r in names]), "hosts")
    n, many, *failed = hosts.agg(F.sum("documents"), F.count(F.lit(1)), *[F.sum(r) for r in names]).first()
    mean = {r: f / n if n else 0.0 for r, f in zip(names, failed)}
    spread = hosts.agg(*[F.sum(F.col("documents") * F.pow(F.col(r) / F.col("documents") - mean[r], 2)).alias(r) for r in names]).first()
    rates = {}
    for r in names:
        within = mean[r] * (1 - mean[r])
        beyond = (spread[r] - many * within) / n if n else 0.0
        strength = min(max(within / beyond - 1, LEAST_STRENGTH), MOST_STRENGTH) if beyond > 0 else MOST_STRENGTH
        rates[r] = (F.col(r) + strength * mean[r]) / (F.col("documents") + strength)
    return hosts.select(
        "host", "documents", F.struct(*[rates[r].alias(r) for r in names]).alias("rates"), (rates["any"] > REJECTED).alias("rejected"),
        F.struct(*[(rates[r] > max(LEAST_SUSPECT, TIMES_ALL * mean[r])).alias(r) for r in RULES]).alias("suspect"),
    )


def judged(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` with counts (struct), base_failed, failed (struct: 0 or 1 by rule and
    ``any``, which takes in the base rules), rates (of the host, by rule), host_rejected and kept;
    input columns of these names are replaced.

    A null or empty text has no words and fails the base rules; texts of any length are counted
    whole; a null host is a host; repeated rows are documents of their own; an empty table stays
    empty. Hosts without failures beyond others' drop nothing."""
    added = ("counts", "base_failed", "failed", "rates", "host_rejected", "kept")
    keep = [c for c in docs.columns if c not in added]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("_text"))
    rows = with_counts(rows, F.col("_text")).drop("_text").select("*", "counts.*")
    one = {r: F.expr(f"CAST({rule} AS int)") for r, rule in RULES.items()}
    rows = rows.withColumn("base_failed", F.expr(BASE)).withColumn("failed", F.struct(*[c.alias(r) for r, c in one.items()], F.greatest(F.col("base_failed").cast("int"), *one.values()).alias("any"))).drop(*COUNTS)
    rows = materialize(rows, "counted")
    verdicts = bounded(host_verdicts(rows.select("host", "failed")).select(F.col("host").alias("_host"), F.col("rejected").alias("host_rejected"), "rates", "suspect"))
    out = rows.join(verdicts, rows["host"].eqNullSafe(verdicts["_host"]))
    caught = F.lit(False)
    for r in RULES:
        caught = caught | ((F.col(f"failed.{r}") == 1) & F.col(f"suspect.{r}"))
    out = out.withColumn("kept", ~(F.col("base_failed") | F.col("host_rejected") | caught))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *added)


def op12_host_rules(spark, sf_dir: str) -> DataFrame:
    """The counts and the verdict of every document, with its source as host."""
    rows = judged(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return rows.select("doc_id", *[f"counts.{c}" for c in COUNTS], "base_failed", "host_rejected", *[F.col(f"failed.{r}").alias(f"failed_{r}") for r in RULES], "kept")


def _shrunken(r: str) -> str:
    """SQL of a host's shrunken rate: h has the host's sums, t those of all, s the spreads."""
    within = f"(t.{r} / t.n * (1 - t.{r} / t.n))"
    beyond = f"((s.{r} - t.many * {within}) / t.n)"
    strength = f"(CASE WHEN {beyond} > 0 THEN least(greatest({within} / {beyond} - 1, {LEAST_STRENGTH}), {MOST_STRENGTH}) ELSE {MOST_STRENGTH} END)"
    return f"((h.{r} + {strength} * t.{r} / t.n) / (h.n + {strength}))"


_ALL = [*RULES, "any_rule"]
OP12_SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS u, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT u, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT u, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY u),
v AS (SELECT u, i, list_extract(words, i::BIGINT) || chr(32) || list_extract(words, i::BIGINT + 1) || chr(32) || list_extract(words, i::BIGINT + 2) AS run FROM (SELECT u, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT u, i FROM v QUALIFY count(*) OVER (PARTITION BY u, run) > 1),
r AS (SELECT u, count(DISTINCT i + k) AS n_repeat_words FROM again, range({WINDOW}) g(k) GROUP BY u),
c AS (SELECT w.u, doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN l ON l.u = w.u LEFT JOIN r ON r.u = w.u),
f AS (SELECT *, ({BASE}) AS base_failed, {', '.join(f'({rule})::INT AS {r}' for r, rule in RULES.items())}, ({BASE} OR {' OR '.join(RULES.values())})::INT AS any_rule FROM c),
h AS (SELECT source, count(*)::DOUBLE AS n, {', '.join(f'sum({r})::DOUBLE AS {r}' for r in _ALL)} FROM f GROUP BY source),
t AS (SELECT sum(n) AS n, count(*) AS many, {', '.join(f'sum({r}) AS {r}' for r in _ALL)} FROM h),
s AS (SELECT {', '.join(f'sum(h.n * (h.{r} / h.n - t.{r} / t.n) ** 2) AS {r}' for r in _ALL)} FROM h, t),
hosts AS (SELECT h.source, {_shrunken('any_rule')} > {REJECTED} AS host_rejected, {', '.join(f'{_shrunken(r)} > greatest({LEAST_SUSPECT}, {TIMES_ALL} * t.{r} / t.n) AS suspect_{r}' for r in RULES)} FROM h, t, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, host_rejected, {', '.join(f'f.{r} AS failed_{r}' for r in RULES)},
  NOT (base_failed OR host_rejected OR {' OR '.join(f'f.{r} = 1 AND suspect_{r}' for r in RULES)}) AS kept
FROM f JOIN hosts ON f.source IS NOT DISTINCT FROM hosts.source"""
