"""What the walk leaves out by itself: folders by patterns and names, files by pushed filters."""

import os
import random
import re
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from kindred.functions.paths import FolderRules, glob_regex, patterns_of
from kindred.plans.scan import scan
from kindred.schema import ScanOptions
from kindred.sources import files as file_rows
from kindred.sources.files import walk
from tests.test_engine import names, tree


def ignored(path, patterns):
    """File by file: the last pattern that matches decides."""
    out = False
    for p in patterns_of(patterns):
        expression, ignores = glob_regex(p)
        if re.search(expression, path):
            out = ignores
    return out


@pytest.mark.parametrize("patterns,folder,out", [
    (["build/"], "build", True), (["build/"], "a/build/b", True), (["build/"], "builds", False), (["/out/**"], "out", True), (["/out/**"], "a/out", False),
    (["build"], "build", False),  # a name of files
    (["*.tmp"], "a", False), (["build/", "!keep.txt"], "build", False), (["build/", "!/src/keep.txt"], "build", True), (["build/", "!/build/keep.txt"], "build", False),
    (["build/", "!/build/keep.txt"], "build/other", True), (["build/", "!/**/keep.txt"], "build", False), (["!keep.txt", "build/"], "build", True), (["# build/", ""], "build", False), (["a/*/c/"], "a/b/c", True), (["a/*/c/"], "a/b", False),
])
def test_folders_passed_by(patterns, folder, out):
    assert FolderRules(patterns).passed_by(folder) is out


def test_no_wanted_file_lies_in_a_folder_passed_by():
    rng = random.Random(0)
    parts = ["a", "b", "c", "*", "**", "?"]
    for _ in range(3000):
        patterns = ["!" * (rng.random() < 0.4) + "/" * (rng.random() < 0.4) + "/".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "/", "/**"]) for _ in range(rng.randrange(1, 5))]
        folder = "/".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))
        if FolderRules(patterns).passed_by(folder):
            for _ in range(30):
                path = folder + "/" + "/".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))
                assert ignored(path, patterns), (patterns, folder, path)


def listed(monkeypatch, reader):
    """The folders that a reader opens, and its rows."""
    seen, real = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: seen.append(str(p)) or real(p))
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    monkeypatch.setattr(os, "scandir", real)
    return {os.path.basename(p) for p in seen}, rows


def test_ignored_and_hidden_folders_are_not_opened(tmp_path, monkeypatch):
    tree(tmp_path, {"src/a.txt": "x", "src/build/deep/b.txt": "x", ".git/objects/c": "x", "node_modules/m/d.js": "x", "node_modules/m/keep.js": "x", "e": "x"})
    root = str(tmp_path)
    for tasks in (1, 256):  # the driver opens folders, or tasks do
        monkeypatch.setattr(file_rows, "TASKS", tasks)
        folders, rows = listed(monkeypatch, file_rows._Walk({"roots": root, "skipHidden": "true", "ignore": '{"": ["build/", "node_modules/"]}'}))
        assert folders == {tmp_path.name, "src"} and sorted(os.path.basename(r[0]) for r in rows) == ["a.txt", "e"]
        folders, _ = listed(monkeypatch, file_rows._Walk({"roots": root}))
        assert {"build", "deep", ".git", "objects", "node_modules", "m"} <= folders


def test_a_scan_keeps_out_of_folders_and_finds_the_same(spark, tmp_path):
    tree(tmp_path, {"a/x": "same", "a/build/y": "same", ".h/z": "same", "a/w": "same", ".gitignore": "build/\n", "a/line\nend/build/v": "same"})
    got = scan(spark, [str(tmp_path)], ScanOptions(skip_hidden=True))
    assert names(got.members) == ["w", "x"]
    (tmp_path / "a" / "build").chmod(0o755)
    assert names(scan(spark, [str(tmp_path)], ScanOptions(ignore=("!y",))).members) == ["w", "x", "y", "z"]


def pushed(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan, [line for line in plan.splitlines() if "BatchScan" in line or "PushedFilters" in line or "fswalk" in line]


def test_sizes_and_times_reach_the_walk(spark, tmp_path):
    tree(tmp_path, {"small": "x", "mid": "x" * 50, "large": "x" * 500, "old": "x" * 60})
    for n in ("small", "mid", "large"):
        os.utime(tmp_path / n, (1700000000, 1700000000))
    os.utime(tmp_path / "old", (1500000000.25, 1500000000.25))
    files, errors = walk(spark, [str(tmp_path)])
    kept = files.filter((F.col("size") >= 50) & (F.col("size") < 500))
    plan, scans = pushed(kept)
    assert not re.search(r"Filter .*size", plan), plan  # nothing is left for Spark to do
    assert names(kept) == ["mid", "old"]
    since = files.filter(F.col("modified") > F.lit(datetime(2020, 1, 1, tzinfo=UTC)))
    assert not re.search(r"Filter .*modified", pushed(since)[0]) and names(since) == ["large", "mid", "small"]
    assert names(files.filter(F.col("modified") == F.timestamp_micros(F.lit(1500000000250000)))) == ["old"]
    assert names(files.filter((F.col("mtime_ns") == 1500000000250000000) | (F.col("size") == 1))) == ["old", "small"]  # not pushed
    assert names(files.filter(F.col("size").isin(1, 500))) == ["large", "small"]
    assert errors.count() == 0
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert names(files.filter(F.col("modified") < F.lit("2017-07-13 22:40:01").cast("timestamp"))) == ["old"]
        assert names(files.filter(F.col("modified") < F.lit("2017-07-13 22:40:00").cast("timestamp"))) == []
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert names(scan(spark, [str(tmp_path)], ScanOptions(min_size=50, newer_than="2020-01-01")).files) == ["large", "mid"]


def test_paths_reach_the_walk(spark, tmp_path, monkeypatch):
    tree(tmp_path, {"a/b/x": "1", "a/bc/y": "1", "d/z": "1"})
    files, _ = walk(spark, [str(tmp_path)])
    root = os.path.realpath(tmp_path)
    assert names(files.filter(F.col("path").startswith(f"{root}/a/b/"))) == ["x"]
    assert names(files.filter(F.col("path").startswith(f"{root}/a/b"))) == ["x", "y"]
    reader = file_rows._Walk({"roots": root})
    from pyspark.sql.datasource import IsNotNull, StringStartsWith

    assert list(reader.pushFilters([IsNotNull(("path",)), StringStartsWith(("path",), f"{root}/a/b/")])) == []
    folders, rows = listed(monkeypatch, reader)
    assert folders == {os.path.basename(root), "a", "b"} and len(rows) == 1


def test_errors_stay_rows(spark, tmp_path, monkeypatch):
    tree(tmp_path, {"a/x": "1"})
    reader = file_rows._Walk({"roots": f"{tmp_path}/a\n{tmp_path}/none"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[-1] is None for r in rows] == [True, False]
    from pyspark.sql.datasource import GreaterThan, IsNotNull, IsNull

    for filters, left in (([IsNull(("error",))], 1), ([IsNotNull(("error",))], 1), ([GreaterThan(("size",), 0)], 1), ([GreaterThan(("size",), 9)], 0)):
        reader = file_rows._Walk({"roots": f"{tmp_path}/a\n{tmp_path}/none"})
        assert list(reader.pushFilters(filters)) == []
        assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == left
