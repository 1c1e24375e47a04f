"""Where file rows come from: a directory walk, any table, a saved list."""

from __future__ import annotations

import json
import operator
import os
import re
import stat
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith

from kindred.functions.paths import FolderRules
from kindred.operators.dedupe import distinct_paths

WALKED = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("canonical_path", T.StringType()), T.StructField("root", T.StringType()), T.StructField("size", T.LongType()),
    T.StructField("modified", T.TimestampType()), T.StructField("mtime_ns", T.LongType()), T.StructField("is_symlink", T.BooleanType()), T.StructField("is_hardlink", T.BooleanType()),
    T.StructField("dev", T.LongType()), T.StructField("inode", T.LongType()), T.StructField("error", T.StringType()),
])
#: Folders that the driver lists at most, and tasks that it then has enough of.
LISTED, TASKS = 2000, 256


class _Tree(InputPartition):
    def __init__(self, root: str, start: str, deep: bool):
        self.root, self.start, self.deep = root, start, deep


def _instant(value: datetime) -> datetime:
    return value.replace(tzinfo=UTC) if value.tzinfo is None else value


#: Filters that the walk applies itself, by column: how a file's value compares with the filter's.
_COMPARE = {GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, EqualTo: operator.eq}
_COLUMNS = ("size", "mtime_ns", "modified")


class _Walk(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [r for r in options.get("roots", "").split("\n") if r]
        self.follow = str(options.get("followSymlinks", "false")).lower() == "true"
        self.skip_hidden = str(options.get("skipHidden", "false")).lower() == "true"
        self.ignore = json.loads(options.get("ignore") or "{}")
        self.wanted: list[tuple] = []  # (column, comparison, value)
        self.prefixes: list[str] = []
        self.files, self.errors = True, True
        self._rules: dict[str, FolderRules] = {}

    def pushFilters(self, filters):
        """Sizes, times, the start of the path and whether there is an error are looked at before a
        row is made; folders that no wanted path can lie in are not opened."""
        for f in filters:
            path = getattr(f, "attribute", ())  # of a negation there is none
            column = path[0] if len(path) == 1 else None
            if type(f) in _COMPARE and column in _COLUMNS and f.value is not None:
                self.wanted.append((column, type(f), _instant(f.value) if column == "modified" else f.value))
                self.errors = False  # an error has no size and no time
            elif isinstance(f, StringStartsWith) and column == "path":
                self.prefixes.append(f.value)
            elif isinstance(f, IsNotNull) and column in (*_COLUMNS, "path"):
                self.errors = self.errors and column == "path"
            elif isinstance(f, IsNull) and column == "error":
                self.errors = False
            elif isinstance(f, IsNotNull) and column == "error":
                self.files = False
            else:
                yield f

    def _enters(self, root: str, folder: str) -> bool:
        """Whether a folder below a root may hold a wanted file."""
        below = folder[len(root) :].strip("/")
        if below:
            if self.skip_hidden and any(len(step) > 1 and step[0] == "." for step in below.split("/")):
                return False
            rules = self._rules.get(root)
            if rules is None:
                rules = self._rules[root] = FolderRules(self.ignore.get(root, self.ignore.get("", [])))
            if rules.passed_by(below):
                return False
        inside = folder.rstrip("/") + "/"
        return all(inside.startswith(p) or p.startswith(inside) or p == folder for p in self.prefixes)

    def _wants(self, size: int, modified: datetime, mtime_ns: int) -> bool:
        values = {"size": size, "modified": modified, "mtime_ns": mtime_ns}
        return all(_COMPARE[kind](values[column], value) for column, kind, value in self.wanted)

    def partitions(self):
        """Folders are opened level by level until there are enough for all tasks: one task for the
        files right in an opened folder, one for the whole of each that was left closed."""
        opened, closed, listed = [], [(r, r) for r in self.roots if self._enters(r, r)], 0
        while closed and len(closed) < TASKS and listed < LISTED:
            below = []
            for root, folder in closed:
                listed += 1
                opened.append(_Tree(root, folder, False))
                try:
                    below += [(root, e.path) for e in sorted(os.scandir(folder), key=lambda e: e.name) if e.is_dir(follow_symlinks=False) and self._enters(root, e.path)]
                except OSError:
                    pass
                if self.follow:
                    opened += self._linked(root, folder)
            closed = below
        return opened + [_Tree(root, folder, True) for root, folder in closed]

    def _linked(self, root: str, folder: str) -> Iterable[_Tree]:
        """Links to folders are whole tasks, as they may lead round in circles."""
        try:
            return [_Tree(root, e.path, True) for e in sorted(os.scandir(folder), key=lambda e: e.name) if e.is_symlink() and e.is_dir() and self._enters(root, e.path)]
        except OSError:
            return []

    def read(self, tree):
        todo, seen = [tree.start], set()
        failed = lambda path, e: (path, None, tree.root, None, None, None, None, None, None, None, str(e))
        while todo:
            folder = todo.pop()
            try:
                real = os.path.realpath(folder)
                if real in seen:
                    continue
                seen.add(real)
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError as e:
                if self.errors and self._named(folder):
                    yield failed(folder, e)
                continue
            below = []
            for e in entries:
                try:
                    link = e.is_symlink()
                    if e.is_dir(follow_symlinks=self.follow):
                        if tree.deep and self._enters(tree.root, e.path):
                            below.append(e.path)
                        continue
                    if link and not self.follow or not self._named(e.path):
                        continue
                    s = e.stat(follow_symlinks=True)
                    modified = datetime.fromtimestamp(s.st_mtime, UTC)
                    if self.files and stat.S_ISREG(s.st_mode) and self._wants(s.st_size, modified, s.st_mtime_ns):
                        yield (e.path, os.path.realpath(e.path), tree.root, s.st_size, modified, s.st_mtime_ns, link, s.st_nlink > 1, s.st_dev, s.st_ino, None)
                except OSError as x:
                    if self.errors:
                        yield failed(e.path, x)
            todo += reversed(below)

    def _named(self, path: str) -> bool:
        return all(path.startswith(p) for p in self.prefixes)


class FileWalk(DataSource):
    """``fswalk``: regular files below roots that all executors can read, without their content.
    Errors are rows. Options: roots (one a line), followSymlinks, skipHidden (folders with a dot in
    front are not entered), ignore (patterns by root as JSON; "": of all others; folders that they
    ignore whole are not entered, and files are left to the caller)."""

    @classmethod
    def name(cls):
        return "fswalk"

    def schema(self):
        return WALKED

    def reader(self, schema):
        return _Walk(dict(self.options))


def normalized_roots(roots: list[str]) -> list[str]:
    """Existing folders by their real paths, without those inside another."""
    real = sorted({os.path.realpath(r) for r in roots if os.path.isdir(r)}, key=lambda r: (len(r), r))
    out: list[str] = []
    for r in real:
        if not any(r == o or r.startswith(o.rstrip("/") + "/") for o in out):
            out.append(r)
    return out


def root_ignores(roots: list[str]) -> dict[str, tuple[str, ...]]:
    """The lines of each root's .gitignore."""
    out = {}
    for r in roots:
        try:
            with open(os.path.join(r, ".gitignore"), encoding="utf-8", errors="replace") as f:
                out[r] = tuple(f.read().splitlines())
        except OSError:
            continue
    return out


def walk(spark: SparkSession, roots: list[str], follow_symlinks: bool = False, skip_hidden: bool = False, ignore: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, errors) below the roots, each file once by its real path. Rows tell about files and
    do not hold them; what needs their content reads it by path. ``is_hardlink``: the file has
    other names too. Filters on sizes, times and the start of paths reach the walk itself, for
    which the session lets Python sources take filters from now on. ``skip_hidden`` and ``ignore``
    (patterns by root) keep it out of folders; they drop no single files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileWalk)
    source = spark.read.format("fswalk").option("roots", "\n".join(normalized_roots(roots))).option("followSymlinks", follow_symlinks)
    rows = source.option("skipHidden", skip_hidden).option("ignore", json.dumps(ignore or {})).load()
    files = rows.filter("error IS NULL").drop("error")
    if follow_symlinks:  # else no two paths lead to one file
        files = distinct_paths(files, "canonical_path")
    return files.withColumn("group_name", F.lit(None).cast("string")), rows.filter("error IS NOT NULL").select("path", "error")


def from_table(df: DataFrame, path: Column, text: Column, modified: Column, group_name: Column | None = None, root: Column | None = None) -> DataFrame:
    """File rows from any table with a text column; nothing is filtered."""
    return df.select(
        path.alias("path"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"), modified.alias("modified"), F.lit(False).alias("is_symlink"), F.lit(False).alias("is_hardlink"),
        (group_name if group_name is not None else F.lit(None).cast("string")).alias("group_name"), (root if root is not None else F.lit("")).alias("root"), text.alias("text"), text.cast("binary").alias("content"),
    )


_GROUP = re.compile(r"([A-Za-z0-9_-]+)=(.+)", re.S)


def parse_named_root(text: str) -> tuple[str, str]:
    """(name, path) of ``NAME=PATH``."""
    found = _GROUP.fullmatch(text)
    if not found:
        raise ValueError(f"expected NAME=PATH with a name of letters, digits, _ and -: {text!r}")
    return found[1], found[2]
