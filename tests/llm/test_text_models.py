import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import chat, langid, quality, toxicity
from tests.llm.awkward import ROWS, documents, labels
from tests.oracle import agrees

SF = "/root/testdata/sf0.01"


def crc(i):
    return zlib.crc32(str(i).encode())


def test_languages_of_held_out_documents(spark):
    rows = langid.op6_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    assert all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    out = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert np.mean(out) > 0.98


def test_language_scores_by_brute_force(spark):
    """Families, then votes of pairs, written out for one text at a time."""
    docs = [(r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    model = langid.Model.fit(langid.vectors([t for t, _ in docs]), np.array([c for _, c in docs]))
    texts = [t for t, _ in docs[:60]] + ["12", None, "é"]
    langs, scores = model.predict(texts)
    for text, lang, score in zip(texts, langs, scores):
        if not any(map(str.isalpha, text or "")):
            assert (lang, score) == ("und", 0)
            continue
        grams = np.zeros(1 << langid.BITS)
        raw = f" {text.lower()} ".encode()
        for a, b, c in zip(raw, raw[1:], raw[2:]):
            grams[(((a | b << 8 | c << 16) * 2654435761) % 2**32) >> (32 - langid.BITS)] += 1
        x = np.sqrt(grams) / np.sqrt(grams.sum())
        sure = lambda m: 1 / (1 + np.exp(-(m.slope * (x @ m.weights + m.bias) + m.shift)))  # noqa: E731, B023
        family = {n: sure(m) for n, m in model.of_family.items()} or {n: 1.0 for n in model.families}
        first = max(family, key=family.get)
        votes = dict.fromkeys(model.families[first], 1.0)
        for (a, b), m in model.pairs[first].items():
            votes[a] *= sure(m)
            votes[b] *= 1 - sure(m)
        assert lang == max(votes, key=votes.get)
        assert score == pytest.approx(family[first] / sum(family.values()) * votes[lang] / sum(votes.values()), abs=1e-4)


def test_many_languages_share_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ALL", 40)
    seen, real = [], langid.Model.fit
    monkeypatch.setattr(langid.Model, "fit", lambda x, lang: seen.append(list(lang)) or real(x, lang))
    rows = [(100 * n + i, f"{chr(97 + n) * 3} {chr(98 + n) * 2} {i}", f"x{n:02}", "a") for n in range(20) for i in range(9)] * 2
    langid.fit(documents(spark, rows))
    assert len(seen[0]) == 40 and {seen[0].count(c) for c in seen[0]} == {2}
    monkeypatch.setattr(langid, "SAMPLE_ALL", 5)
    langid.fit(documents(spark, rows))
    assert sorted(seen[1]) == [f"x{n:02}" for n in range(20)]  # one text of each at least


def test_languages_awkward_rows(spark):
    df = documents(spark)
    got = langid.identify(df)
    rows = got.collect()
    assert set(got.columns) == {*df.columns, "lang_pred"} and len(rows) == len(ROWS)
    for r in rows:
        if not any(map(str.isalpha, r["text"] or "")):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in {"en", "de", "es", "fr"}
    assert langid.identify(documents(spark, [])).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_every_language_is_learned(spark):
    word = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(3))
    rows = [(100 * n + i, " ".join(word(137 * n + 11 * j) * 2 for j in range(8)), f"x{n:02}", "a") for n in range(70) for i in range(3 if n < 66 else 2)]
    model = langid.fit(documents(spark, rows))
    assert sorted(c for codes in model.families.values() for c in codes) == [f"x{n:02}" for n in range(70)]
    assert model.predict([text for _, text, *_ in rows])[0] == [lang for _, _, lang, _ in rows]


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    yes = label == 1
    return (rank[yes].sum() - yes.sum() * (yes.sum() + 1) / 2) / (yes.sum() * (~yes).sum())


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert auc(np.array([r["score"] for r in out]), np.array([r["toxic"] for r in out])) > 0.9
    assert sum(r["predicted"] and not r["toxic"] for r in out) <= 0.01 * len(out)


def test_pairs_of_terms_are_learned():
    sets, y = [], []
    for i in range(400):
        a, b = i % 2, i // 2 % 2
        sets.append(np.array([t for t, on in ((1, a), (2, b), (3, True)) if on]))
        y.append(float(a and b))
    model = toxicity.learn(sets, np.array(y), 0.5)
    f = lambda *t: model.bias + sum(model.weights[model.columns[x]] for x in t) + (model.vectors[model.columns[1]] @ model.vectors[model.columns[2]] if {1, 2} <= set(t) else 0)
    assert f(1, 2) > 0 > max(f(1), f(2))


def test_terms_that_tell_only_together_are_learned():
    sets = [np.array([t for t, on in ((1, i % 2), (2, i // 2 % 2), (3, i % 3 == 0), (4, i == 7 or i == 11)) if on], int) for i in range(480)]
    y = np.array([float(i % 2 != i // 2 % 2) for i in range(480)])
    model = toxicity.learn(sets, y, 0.5)
    assert set(model.columns) == {1, 2, 3, 4}
    f = lambda *t: model.bias + sum(model.weights[model.columns[x]] for x in t) + (model.vectors[model.columns[1]] @ model.vectors[model.columns[2]] if {1, 2} <= set(t) else 0)
    assert min(f(1), f(2)) > 0 > max(f(), f(1, 2))


def test_toxicity_scores_by_brute_force():
    """Weights and products of all pairs of terms, added up one by one."""
    rng = np.random.default_rng(6)
    words = ["you", "stupid", "people", "lovely", "weather", "idiots", "thing", "thinking"]
    terms = sorted({t for w in words[:6] for t in toxicity.terms_of(w)})
    model = toxicity.Machine(-0.3, {t: i for i, t in enumerate(terms)}, rng.normal(size=len(terms)), rng.normal(0, 0.4, (len(terms), toxicity.RANK)))
    texts = [None, "", "12 !!", "Stupid STUPID people", "You, lovely weather; idiots you", "thing thinking", "nothing known"]
    for text, score in zip(texts, model.scores(texts)):
        on = sorted({t for w in toxicity.LETTERS.findall((text or "").lower()) for t in toxicity.terms_of(w)} & set(terms))
        f = model.bias + sum(model.weights[model.columns[t]] for t in on)
        f += sum(model.vectors[model.columns[a]] @ model.vectors[model.columns[b]] for i, a in enumerate(on) for b in on[:i])
        assert score == pytest.approx(1 / (1 + np.exp(-f)))
    assert model.scores([]).shape == (0,)


def test_toxicity_awkward_rows(spark):
    df = documents(spark)
    rows = toxicity.toxicity(df, labels(spark)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(documents(spark, []), labels(spark)).count() == 0
    none = toxicity.toxicity(df, labels(spark).limit(0)).collect()
    assert {r["predicted"] for r in none} == {0}


def test_quality_of_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality.op10_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").collect()
    assert np.mean([r["good"] == r["quality"] for r in rows]) > 0.99
    assert min(r["quality_score"] for r in rows if r["quality"]) > 0.5


def brute_posteriors(rows):
    """(host posterior, path posterior) of each row, by the sums of all other rows of its sites."""
    def strength(groups):
        total = sum(n for n, *_ in groups)
        mean = sum(n * c * (1 - c) for n, _, c in groups) / total
        variance = (sum(n * (g / n - c) ** 2 for n, g, c in groups) - len(groups) * mean) / total
        return quality.MOST_STRENGTH if len(groups) < 2 or variance <= 0 else float(np.clip(mean / variance - 1, quality.LEAST_STRENGTH, quality.MOST_STRENGTH))

    rate = min(max(np.mean([e for *_, e in rows]), 1e-4), 1 - 1e-4)
    sums = lambda key: {k: (len(v := [e for *site, e in rows if key(*site) == k]), sum(v)) for k in {key(h, p) for h, p, _ in rows}}
    hosts, paths = sums(lambda h, p: h), sums(lambda h, p: (h, p))
    a = strength([(n, g, rate) for n, g in hosts.values()])
    b = strength([(n, g, (hosts[h][1] + a * rate) / (hosts[h][0] + a)) for (h, _), (n, g) in paths.items()])
    out = []
    for i, (h, p, _) in enumerate(rows):
        others = [r for j, r in enumerate(rows) if j != i]
        here, there = [e for x, _, e in others if x == h], [e for x, y, e in others if (x, y) == (h, p)]
        host = (sum(here) + a * rate) / (len(here) + a)
        out.append((h, p, host, (sum(there) + b * host) / (len(there) + b)))
    return out


def posteriors(spark, rows):
    df = spark.createDataFrame(rows, "host string, path string, evidence double")
    site = quality.posteriors(df).withColumnsRenamed({"host": "h", "path": "p"})
    host, path = quality.prior(F.col("evidence"))
    return df.join(site, df["host"].eqNullSafe(site["h"]) & df["path"].eqNullSafe(site["p"])).select("host", "path", host.alias("of_host"), path.alias("of_path"), "rate")


def test_posteriors_shrink_sparse_sites(spark):
    rows = [("big", "a", 0.1)] * 400 + [("big", "b", 0.2)] * 400 + [("good", "a", 0.95)] * 400 + [("tiny", "a", 0.0)] + [(None, None, 1.0)]
    got = {(r["host"], r["path"]): r for r in posteriors(spark, rows).collect()}
    rate = np.mean([e for *_, e in rows])
    assert got["big", "a"]["rate"] == pytest.approx(rate)
    assert abs(got["big", "a"]["of_path"] - 0.1) < 0.02 and abs(got["good", "a"]["of_host"] - 0.95) < 0.02
    for alone in (("tiny", "a"), (None, None)):  # what a document says of itself is no prior
        assert got[alone]["of_host"] == pytest.approx(rate) and got[alone]["of_path"] == pytest.approx(rate)


def test_posteriors_by_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(f"h{h}" if h else None, f"p{rng.integers(3)}", float(rng.beta(1 + h, 3))) for h in rng.integers(0, 6, 200)]
    got = sorted((tuple(r)[:4] for r in posteriors(spark, rows).collect()), key=str)
    want = sorted(brute_posteriors(rows), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    by = lambda x: [(str(r[0]), r[1], round(r[2], 9), round(r[3], 9)) for r in x]
    assert sorted(by(got)) == sorted(by(want))


def test_quality_by_real_hosts_and_paths(spark):
    """Pages judged on the sites of their URLs by a model of labelled documents."""
    sf = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    host, path = quality.site_of(F.col("url"))
    text = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</\\1>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    rows = pages.select(F.col("page_id").alias("doc_id"), text.alias("text"), host.alias("host"), path.alias("path"))
    got = quality.judged(rows, spark.read.parquet(f"{sf}/labels.parquet").filter("doc_id < 2500"), host="host", path="path").collect()
    assert len(got) == pages.count() and len({r["host"] for r in got}) > 20 and {r["path"] for r in got} >= {"/en", "/de"}
    want = {(h, p, round(a, 9), round(b, 9)) for h, p, a, b in brute_posteriors([(r["host"], r["path"], r["evidence"]) for r in got[:400]])}
    again = posteriors(spark, [(r["host"], r["path"], r["evidence"]) for r in got[:400]]).collect()
    assert {(r["host"], r["path"], round(r["of_host"], 9), round(r["of_path"], 9)) for r in again} == want


@pytest.mark.parametrize("url,site", [("HTTPS://www.A.org:80/x/y?q=/z/", ("a.org", "/x")), ("http://m.b.net/p", ("b.net", "/")), ("c.de", ("c.de", "/")), ("", ("", "/")), (None, (None, None))])
def test_sites(spark, url, site):
    df = spark.createDataFrame([(url,)], "url string")
    assert tuple(df.select(*quality.site_of(F.col("url"))).first()) == site


def test_quality_of_documents_not_learned_from(spark):
    sf = "/root/testdata/sf0.1"
    docs, marks = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = langid.held_out(F.col("doc_id"), 5, 0)
    rows = quality.judged(docs.select("doc_id", "text", "source", "lang"), marks.filter(~out)).join(marks.filter(out).select("doc_id", "quality"), "doc_id").collect()
    assert len(rows) > 500 and np.mean([r["good"] == r["quality"] for r in rows]) > 0.98
    assert auc(np.array([r["quality_score"] for r in rows]), np.array([r["quality"] for r in rows])) > 0.99


def test_quality_awkward_rows(spark):
    df = documents(spark)
    got = quality.judged(df, labels(spark))
    assert got.count() == len(ROWS) and set(df.columns) <= set(got.columns)
    assert quality.judged(documents(spark, []), labels(spark)).count() == 0
    assert quality.judged(df, labels(spark).limit(0)).count() == len(ROWS)


def test_chat_agrees_with_sql(spark):
    agrees(chat.op5_chat(spark, SF), chat.OP5_SQL, SF)


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|x", "a<|b<\\\\|c<", "<<||>>", "<|im_start|>assistant\nhi<|im_end|>\n", "\\|<", "é\U0001f600<|"])
def test_turns_round_trip(text):
    segment, start, length, _ = chat.format_turn(text, [{"type": "text", "text": text}])
    assert chat.read_turn(segment) == (text, text)
    assert chat.unescape(segment[start : start + length]) == text
    assert segment.count("<|im_end|>") == segment.count("<|im_start|>") == 1


def test_parts_become_placeholders():
    parts = [{"type": "text", "text": "see <"}, {"type": "text", "text": "|x"}, {"type": "image", "ref": "i.png", "width": 57, "height": 28}, {"type": "text", "text": " and "}, {"type": "audio", "ref": "a.wav", "seconds": 1.5}, {"type": "document", "ref": "d.pdf", "pages": 3}]
    segment, start, length, attached = chat.format_turn("user", parts)
    assert segment[start : start + length] == "see <\\|x<|image:0|> and <|audio:1|><|document:2|>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in attached] == [("image", "i.png", 3), ("audio", "a.wav", 38), ("document", "d.pdf", 1536)]
    for a in attached:
        assert segment[a["at"] :].startswith(f"<|{a['kind']}:{a['number']}|>")
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])


def test_typed_parts_in_a_table(spark):
    df = spark.createDataFrame([(1, 0, "user", [("image", None, "x", 28, 28, None, None)], "keep"), (1, 1, "assistant", None, "keep")], f"conv_id long, turn long, role string, parts {chat.PARTS}, segment2 string")
    out = chat.format_turns(df, parts="parts")
    rows = out.orderBy("turn").collect()
    assert rows[0]["expanded_tokens"] == 1 and rows[0]["attachments"][0]["ref"] == "x" and rows[1]["loss_length"] == 0
    assert chat.read_back(out).first()["n_turns"] == 2


def test_tied_turns_are_read_in_the_order_of_their_texts(spark, tmp_path):
    texts = ["ab", "ab c", "<|", "<a", "ab<|im_end|>", "", "a\nb", "<\\|", "a!", None]
    rows = [(1, 0, "assistant", t) for t in texts] + [(2, 0, r, t) for r, t in ((None, "z"), ("", "b"), (None, "a"), ("a\nb", "y"), ("a\nb", ""))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.toPandas().to_parquet(tmp_path / "conversations.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    assert sorted(map(tuple, chat.op5_chat(spark, str(tmp_path)).collect())) == sorted(con.sql(chat.OP5_SQL).fetchall())


def test_chat_awkward_rows(spark):
    rows = [(None, 1, None, None, "x"), (1, None, "assistant", "b", "x"), (1, 1, "assistant", "a", "x"), (1, 1, "assistant", "a", "x"), (2, 0, "user\nx", "ü" * 100_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (3, 3, hashlib.sha256(b"baa").hexdigest())
    assert got[2]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(("user\nx\n" + "ü" * 100_000 + "\n").encode()).hexdigest()
    assert got[None]["n_turns"] == 1
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0
