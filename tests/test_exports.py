"""Documents, scripts and sessions that tasks write."""

import json
import os
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import selection
from kindred.plans.scan import ScanError
from kindred.sources import images, parts, session, sinks
from tests.test_engine import members

ODD = ["/d/a\necho INJECTED #", "/d/a\recho INJECTED #", "/d/'; echo INJECTED; '", "/d/\u2019; echo INJECTED; \u2018", "/d/\u2028echo INJECTED", "/d/$(echo INJECTED)`x`", "-rf"]


def odd_plan(spark):
    rows = [(f"g{i}", p, 1, 0, k + 1, False, None) for i, p in enumerate(ODD) for k, p in enumerate((p, p + "2"))]
    return selection.deletion_plan(members(spark, rows))


def test_a_posix_script_runs_no_name(spark, tmp_path):
    path = tmp_path / "o.sh"
    sinks.write_script(odd_plan(spark), str(path))
    done = subprocess.run(["sh", str(path)], capture_output=True, check=True)
    told = done.stdout.decode()
    for p in ODD:  # each deletion is printed whole, as the arguments of one command
        told = told.replace(f"rm -f -- {p}2\n", "", 1)
    assert told == "" and done.stderr == b""
    sinks.write_script(odd_plan(spark), str(path), confirm=True)
    kept = [x for x in path.read_bytes().split(b"\n") if x.startswith(b"# keep ")]
    assert len(kept) == len(ODD) and not any(b"\r" in x for x in kept)


def test_comments_are_one_line_in_either_shell(spark):
    for kind in ("posix", "powershell"):
        lines = [r["line"] for r in selection.script_lines(odd_plan(spark), kind).collect() if r["line"].startswith("#")]
        assert len(lines) == len(ODD) and all(len(x.splitlines()) == 1 for x in lines)


def unquoted(text):
    """What PowerShell reads of a string in single quotes, of which any of four marks ends it."""
    marks = "'\u2018\u2019\u201a\u201b"
    assert text[0] in marks and text[-1] in marks
    out, i, body = "", 0, text[1:-1]
    while i < len(body):
        if body[i] in marks:
            assert body[i + 1] in marks
            i += 1
        out, i = out + body[i], i + 1
    return out


def test_powershell_strings_hold_the_whole_name(spark):
    got = [r["line"] for r in selection.script_lines(odd_plan(spark), "powershell", True).orderBy("group_id", "rank_in_group").collect() if r["line"].startswith("Remove")]
    assert [unquoted(x.removeprefix("Remove-Item -LiteralPath ")) for x in got] == [p + "2" for p in ODD]


def many(spark, groups, each):
    rows = spark.range(groups * each)
    g, k = (F.col("id") / each).cast("long"), F.col("id") % each
    return rows.select(F.format_string("%06d", g).alias("group_id"), F.format_string('/%d/"%d"\n<é>', k, g).alias("path"), (g + 1).alias("size"), (k + 1).cast("int").alias("rank_in_group"), F.timestamp_seconds(k).alias("modified"), F.lit("n").alias("group_name"), (k == 0).alias("is_reference"), F.lit(False).alias("is_similar"))


def test_json_of_many_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(parts, "PART_ROWS", 150)
    one = spark.createDataFrame([(1, 2.5)], "duplicate_groups long, wasted double")
    path = tmp_path / "o.json"
    sinks.write_json(many(spark, 40, 20), one, str(path), {"a": "é"}, "now")
    got = json.loads(path.read_text())
    assert [(g["hash"], g["size"], g["files"]) for g in got["duplicates"]] == [(f"{g:06}", g + 1, [f'/{k}/"{g}"\n<é>' for k in range(20)]) for g in range(40)]
    assert got["summary"] == {"duplicate_groups": 1, "wasted": 2.5} and got["metadata"]["config"] == {"a": "é"}
    sinks.write_json(many(spark, 1, 3).limit(0), one, str(path), {}, "now")  # in place of the other
    assert json.loads(path.read_text())["duplicates"] == []
    assert sorted(os.listdir(tmp_path)) in (["o.json"], [".o.json.crc", "o.json"])


def test_a_hot_group_is_in_many_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(parts, "PART_ROWS", 100)
    lines = sinks.json_lines(many(spark, 1, 2000))
    assert lines.count() == 2000 and lines.agg(F.max(F.length("line"))).first()[0] < 100
    sinks.write_html(many(spark, 1, 2000), spark.createDataFrame([(1,)], "total_size long"), str(tmp_path / "o.html"))
    page = (tmp_path / "o.html").read_text()
    assert page.count("<table>") == page.count("</table>") == 1 and page.count("<tr>") == 2000 and page.count("(reference)") == 1
    assert "&quot;0&quot;\n&lt;é&gt;" in page and page.index("/7/") < page.index("/1999/")


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    (tmp_path / "old.txt").write_text("old")
    broken = spark.range(100).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).alias("line"))
    for name in ("new.txt", "old.txt"):
        with pytest.raises(Exception, match="broken"):
            parts.write_document(broken, ["id"], "line", str(tmp_path / name), rows=100)
    assert os.listdir(tmp_path) == ["old.txt"] and (tmp_path / "old.txt").read_text() == "old"


def test_thumbnails_are_made_by_tasks(spark, tmp_path):
    (tmp_path / "i.png").write_bytes(images.as_png(np.zeros((2, 2, 3), np.uint8)))
    m = members(spark, [("g", str(tmp_path / "i.png"), 5, 1, 1, False, None), ("g", "/gone.png", 5, 2, 2, False, None), ("g", "/a.txt", 5, 3, 2, False, None)])
    assert [r["line"].count("data:image/png;base64,") for r in sinks.html_lines(m, True).orderBy("rank_in_group").collect()] == [1, 0, 0]
    assert [r["line"].count("file:///") for r in sinks.html_lines(m, True, embed=False).orderBy("rank_in_group").collect()] == [1, 1, 0]


# Sessions.


def saved(spark, path, m, **more):
    session.save(str(path), m, m.filter("rank_in_group > 1").select("path"), {"x": [1, "é"]}, ["/"], "2024-01-01T00:00:00Z", **more)


def test_sessions_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "PART_ROWS", 40)
    m = many(spark, 30, 7)
    saved(spark, tmp_path / "s", m)
    got = session.load(spark, str(tmp_path / "s"))
    key = lambda r: (r["group_id"], r["rank_in_group"])
    assert [r.asDict() for r in sorted(got.members.collect(), key=key)] == [r.asDict() for r in sorted(m.select(*got.members.columns).collect(), key=key)]
    assert got.selections.count() == 180 and got.head["settings"] == {"x": [1, "é"]} and (got.head["groups"], got.head["files"]) == (30, 210)
    with pytest.raises(Exception, match="exist"):
        saved(spark, tmp_path / "s", m)
    bare = members(spark, [("g", "/a", 5, 1, 1, False, None)]).drop("group_name", "is_reference")
    saved(spark, tmp_path / "bare", bare)
    assert session.load(spark, str(tmp_path / "bare")).members.first()["group_name"] is None
    saved(spark, tmp_path / "none", bare.limit(0))
    assert session.load(spark, str(tmp_path / "none")).members.count() == 0


@pytest.mark.parametrize("what", ["groups", "selections", "head", "missing part", "renamed part"])
def test_changed_sessions_are_refused(spark, tmp_path, what):
    saved(spark, tmp_path / "s", many(spark, 20, 3))
    folder = tmp_path / "s" / ("selections" if what == "selections" else "groups")
    part = next(p for p in sorted(folder.iterdir()) if p.name.startswith("part-"))
    if what == "head":
        p = tmp_path / "s" / "session.json"
        p.write_text(p.read_text().replace('"files": 60', '"files": 61'))
    elif what == "missing part":
        part.unlink()
    elif what == "renamed part":
        part.rename(folder / "part-9.json")
    else:
        raw = bytearray(part.read_bytes())
        raw[len(raw) // 2] ^= 1
        part.write_bytes(raw)
    for p in [*folder.iterdir(), *(tmp_path / "s").iterdir()]:  # the file system's own sums would tell first
        if p.name.endswith(".crc"):
            p.unlink()
    with pytest.raises(session.SessionError, match="checksum"):
        session.load(spark, str(tmp_path / "s"))


def test_no_session(spark, tmp_path):
    with pytest.raises(session.SessionError, match="not a session"):
        session.load(spark, str(tmp_path))
    assert issubclass(ScanError, RuntimeError)


def test_digest_levels(spark, tmp_path, monkeypatch):
    """Digests of many parts are hashed by groups, and do not depend on how tasks met them."""
    spark.range(60).repartition(60).write.json(str(tmp_path / "d"))
    seen = set()
    for branches in (256, 4, 4):
        monkeypatch.setattr(parts, "BRANCHES", branches)
        seen.add(parts.folder_digest(spark, str(tmp_path / "d")))
    assert len(seen) == 2 and all(len(x) == 64 for x in seen)
