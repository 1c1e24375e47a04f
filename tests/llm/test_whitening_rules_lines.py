"""Exact whitening, host-level rules and first-seen lines."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import hostrules, seenlines, whitening
from kindred.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.awkward import LONG, ROWS, documents
from tests.oracle import agrees

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_host_rules", "op13_seen_lines"])
def test_queries_agree_with_sql(spark, name):
    agrees(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


# Whitening.


def exact(vectors):
    """Whole numbers, n, sums and scatter by Python's integers."""
    whole = [tuple(int(np.floor(256 * np.float64(c))) for c in v) for v in vectors]
    fit = sorted(set(whole))
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    m = [[n * sum(x[a] * x[b] for x in fit) - sums[a] * sums[b] for b in range(d)] for a in range(d)]
    return whole, n, sums, m


def embeddings(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, key string").withColumn("x", F.lit("other"))


def test_whitening_of_all_embeddings(spark):
    rows = QUERIES["op11_whitening"](spark, SF).collect()
    held = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    whole, n, sums, m = exact(held.values())
    of = dict(zip(held, whole))
    values = np.linalg.eigvalsh(np.array([[x / n**2 for x in r] for r in m]))[::-1]
    assert len(rows) == 4 * len(held) and {r["n"] for r in rows} == {n}
    got = {(r["vec_id"], r["component"]): r for r in rows}
    for i, x in of.items():
        assert got[i, 1]["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums))
    for k in range(1, 5):
        assert got[next(iter(of)), k]["explained"] == pytest.approx(values[k - 1] / values.sum(), rel=1e-9)
    fit = {x: i for i, x in of.items()}
    w = np.array([[got[i, k]["whitened"] for k in range(1, 5)] for i in fit.values()])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(4)).max() < 1e-9 and np.abs(w.mean(axis=0)).max() < 1e-9
    assert rows[0]["identity_error"] < 1e-9
    # Each component is a projection: the vectors explain it without a rest.
    x = np.array([[float(a) for a in v] for v in fit]) - np.array([s / n for s in sums])
    part, rest = np.linalg.lstsq(x, w, rcond=None)[:2]
    assert rest.size == 0 or rest.max() < 1e-15
    assert np.allclose(np.linalg.norm(part, axis=0) * np.sqrt(values[:4]), 1)


@pytest.mark.parametrize("offset", [0.0, 1e9, -1e13, 3e15])
def test_scatter_is_exact_at_any_offset(spark, monkeypatch, offset):
    monkeypatch.setattr(whitening, "SHIFT_SAMPLE", 1)
    rng = np.random.default_rng(3)
    vectors = [[offset + float(a) * 10.0 ** (3 * (i % 5)) for a in rng.normal(size=5)] for i in range(60)]
    _, n, sums, m = exact(vectors)
    df = embeddings(spark, [(i, v, "") for i, v in enumerate(vectors)], "double").select(whitening.whole(F.col("embedding")).alias("x")).distinct()
    got = whitening.scatter(df, 5)
    assert got[0] == n and got[1] == sums and [list(r) for r in got[2]] == m


def test_sums_are_told_before_they_are_too_large(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 3)
    monkeypatch.setattr(whitening, "SUMS", 2)
    vectors = [[i * 2.0**40, -i * 3.0] for i in range(50)]
    _, n, sums, m = exact(vectors)
    got = whitening.scatter(embeddings(spark, [(i, v, "") for i, v in enumerate(vectors)], "double").select(whitening.whole(F.col("embedding")).alias("x")), 2)
    assert (got[0], got[1], [list(r) for r in got[2]]) == (n, sums, m)


def test_far_and_flat_dimensions(spark):
    """One dimension a billion off, one that is 10^7 times as wide as the others, one constant."""
    rng = np.random.default_rng(5)
    vectors = [[1e9 + float(a), 1e7 * float(b), float(c), 5.0] for a, b, c in rng.normal(size=(400, 3))]
    rows, model, error = whitening.fit_and_whiten(embeddings(spark, [(i, v, "") for i, v in enumerate(vectors)], "double"))
    whole, n, sums, m = exact(vectors)
    assert len(model.eigenvalues) == 3 and error < 1e-6  # the constant one spans nothing
    v = np.array([[float(Fraction(x, n * n)) for x in r] for r in m])
    small = np.linalg.eigvalsh(v[np.ix_([0, 2], [0, 2])] - np.outer(v[[0, 2], 1], v[1, [0, 2]]) / v[1, 1])[::-1]
    assert model.eigenvalues[1:] == pytest.approx(list(small), rel=1e-6)
    got = rows.orderBy("key").collect()
    assert [int(r["deviation"]) for r in got] == [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in whole]


def test_whitening_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a"), (2, None, "a"), (3, [1.0, None], "a"), (4, [nan, 1.0], "a"), (5, [inf, 1.0], "a"), (6, [-inf, 0.0], "a"), (7, [], "a"), (8, [1.0, 2.0, 3.0], "a"), (None, [3.0, -1.0], None), (9, [-0.0, 4.0], "a"), (9, [1.0, 2.0], "b"), (9, [1.0, 2.0], "b")]
    out, model, error = whitening.fit_and_whiten(embeddings(spark, rows))
    got = sorted((str(r["key"]), int(r["deviation"])) for r in out.collect())
    whole, n, sums, _ = exact([[1, 2], [3, -1], [0, 4]])
    dev = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in whole]
    assert got == sorted([("1", dev[0]), ("None", dev[1]), ("9", dev[2]), ("9", dev[0]), ("9", dev[0])])
    assert model.n == 3 and len(model.eigenvalues) == 2 and error < 1e-9
    for same in ([], [(1, [1.0, 2.0], "a"), (2, [1.0, 2.0], "a")], [(1, None, "a")]):
        out, model, error = whitening.fit_and_whiten(embeddings(spark, same))
        assert out.count() == 0 and model is None and error == 0


def test_rank_by_primes():
    a = np.array([[1, 2, 3], [2, 4, 6], [1, 0, 1]], dtype=object) * 10**30
    assert [whitening.least_rank(a.T @ a, k) for k in (1, 2, 3)] == [1, 2, 2]
    assert whitening.least_rank(np.zeros((3, 3), dtype=object), 3) == 0
    assert whitening.least_rank(np.array([[whitening.PRIMES[0]]], dtype=object), 1) == 1


# Host rules.


def slowly(text):
    """The counts by their definition."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


TEXTS = [None, "", " \n\t", "a b c a b c", "a b c d a b c x\nq\nq\n q\n\n", "é ü # * ¶ a|b <x> $%&", "x x x x", "one\rtwo\vthree\x0cfour", "z " * 50, "l\n" * 9 + "m"]


@pytest.mark.parametrize("text", TEXTS)
def test_counts_by_definition(text):
    assert hostrules.counted(text) == slowly(text)


def test_counts_of_random_texts():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab#é \n\t|") for _ in range(rng.randrange(120)))
        assert hostrules.counted(text) == slowly(text)


def good(i):
    return " ".join(f"word{i}x{k}" for k in range(60))


def noisy(i):
    return " ".join(f"w{i}y{k}" + "#" * (k % 5 == 0) for k in range(60))


def shrunken(hosts, rule):
    """Shrunken rates by host of (documents, failures), by the method of moments."""
    n, f = sum(a for a, _ in hosts.values()), sum(b for _, b in hosts.values())
    mean = f / n
    beyond = (sum(a * (b / a - mean) ** 2 for a, b in hosts.values()) - len(hosts) * mean * (1 - mean)) / n
    strength = min(max(mean * (1 - mean) / beyond - 1, 4), 1000) if beyond > 0 else 1000
    return {h: (b + strength * mean) / (a + strength) for h, (a, b) in hosts.items()}, mean


def test_hosts_decide_whether_a_softer_rule_counts(spark):
    rows = [(i, noisy(i) if i % 3 else good(i), "en", "bad") for i in range(60)]
    rows += [(100 + i, noisy(i) if i % 30 == 0 else good(i), "en", f"fine{i % 6}") for i in range(300)]
    rows += [(900, noisy(900), "en", "tiny"), (901, "short", "en", "tiny"), (902, noisy(902), "en", None)]
    rows += [(1000 + i, noisy(i) if i else good(i), "en", "junk") for i in range(300)]
    got = {r["doc_id"]: r for r in hostrules.judged(documents(spark, rows)).collect()}
    hosts = {}
    for i, text, _, host in rows:
        n, f = hosts.get(host, (0, 0))
        hosts[host] = n + 1, f + ("#" in text)
    rates, mean = shrunken(hosts, "symbols")
    for i, _, _, host in rows:
        assert got[i]["rates"]["symbols"] == pytest.approx(rates[host])
    assert mean > 0.4 and rates["bad"] < 2 * mean and all(got[i]["kept"] for i in range(60))  # noise is common here
    assert got[1000]["host_rejected"] and not any(got[1000 + i]["kept"] for i in range(300))
    calm = {r["doc_id"]: r for r in hostrules.judged(documents(spark, [r for r in rows if r[3] != "junk"])).collect()}
    assert all(calm[i]["kept"] == (not i % 3) for i in range(60))  # here it is not, and only noisy ones go
    assert all(calm[100 + i]["kept"] for i in range(300))  # as many as elsewhere
    assert not calm[901]["kept"] and calm[901]["base_failed"]
    assert abs(calm[900]["rates"]["symbols"] - 0.5) > abs(calm[900]["rates"]["symbols"] - 0.14)  # one document tells little


def test_host_rules_awkward_rows(spark):
    df = documents(spark).withColumn("kept", F.lit("x")).withColumn("counts", F.lit(1)).withColumn("n_words", F.lit("y")).withColumn("any", F.lit("z"))
    got = hostrules.judged(df).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert tuple(r["counts"]) == (slowly(r["text"]) if r["text"] != LONG else hostrules.counted(LONG))
        assert r["base_failed"] == (r["counts"]["n_words"] < 50 or 2 * r["counts"]["n_repeat_words"] > r["counts"]["n_words"])
        assert r["n_words"] == "y" and r["any"] == "z" and (not r["base_failed"] or not r["kept"])
    assert hostrules.judged(documents(spark, [])).count() == 0


# First-seen lines.


def batch(i):
    return 10 * (zlib.crc32(str(i).encode() if i is not None else b"") % 64) // 64


def stripped(rows):
    """Documents and lines by a walk over the batches."""
    held, docs, lines = Counter(), [], {}
    key = lambda x: re.sub(r"[A-Z]+", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    for b in range(10):
        own = Counter()
        for i, text in rows:
            if batch(i) == b:
                parts = (text or "").split("\n")
                gone = [len(key(x)) >= 20 and held[key(x)] >= 2 for x in parts]
                for x in (key(x) for x, g in zip(parts, gone) if g):
                    first, n = lines.get(x, (b, 0))
                    lines[x] = first, n + 1
                docs.append((None if i is None else str(i), b, len(parts), sum(gone), "\n".join(x for x, g in zip(parts, gone) if not g)))
                own.update({key(x) for x in parts})
        held += own
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return sorted(docs, key=repr), sorted((sha(x), b, held[x], n) for x, (b, n) in lines.items())


SAID = ["Terms and conditions of this site apply", "  terms AND conditions of this site apply\t", "Ünd noch eine Zeile mit Ümlauten", "ünd noch eine zeile mit ümlauten", "short line", "exactly twenty chars", "nineteen characters", ""]


def seen_rows():
    rng = random.Random(7)
    rows = [(i, "\n".join([rng.choice(SAID) for _ in range(rng.randrange(6))] + [f"a line that stands in document {i} alone"] + [""] * rng.randrange(3))) for i in range(60)]
    rows += [(None, SAID[0]), (None, None), (61, ""), (62, "\n\n"), (63, None), (64, SAID[0]), (64, SAID[0]), (64, SAID[0] + "\n" + SAID[0]), (65, "\n".join(f"{SAID[5]}{k % 7}" for k in range(3000)))]
    return rows + [(i, "\n".join(f"{SAID[5]}{k}" for k in range(7))) for i in range(66, 80)]


@pytest.mark.parametrize("hot", [None, 1])
def test_lines_by_a_walk_over_the_batches(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(seenlines, "LEAST_HOT", hot)
        monkeypatch.setattr(seenlines, "MOST_HOT", 5)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in seen_rows()], "doc_id long, text string, uid string, batch string")
    before = {k: spark.conf.get(k, None) for k in seenlines.STATE}
    out = seenlines.strip_seen(df)
    docs, lines = stripped(seen_rows())
    assert sorted(((r["key"], r["batch"], r["n_all"], r["n_removed"], r["kept"]) for r in out.documents.collect()), key=repr) == docs
    assert sorted((r["key"].hex(), r["batch"], r["n_all"], r["n_removed"]) for r in out.lines.collect()) == lines
    assert any(d[3] for d in docs) and len(lines) > 5
    assert {k: spark.conf.get(k, None) for k in seenlines.STATE} == before


def test_lines_of_awkward_tables(spark):
    df = documents(spark).withColumn("batch", F.lit("x")).withColumn("lines", F.lit("y"))
    out = seenlines.strip_seen(df)
    want = stripped([r[:2] for r in ROWS])
    assert sorted(((r["key"], r["batch"], r["n_all"], r["n_removed"], r["kept"]) for r in out.documents.collect()), key=repr) == want[0]
    assert out.lines.count() == len(want[1])
    none = seenlines.strip_seen(documents(spark, []))
    assert none.documents.count() == 0 and none.lines.count() == 0
