"""Path expressions: names, extensions, roots, globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.schema import CATEGORIES


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower case, without the dot; names that only start with a dot have none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def in_category(path: Column, *names: str) -> Column:
    return extension(path).isin([x for n in names for x in CATEGORIES[n]])


def under(path: Column, root: Column) -> Column:
    """Whether a path is a root or, by whole components, below it."""
    return (path == root) | F.startswith(path, F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.[^/]")


def glob_regex(pattern: str) -> tuple[str, bool]:
    """An ignore pattern as a regular expression on a relative path, and whether it ignores
    (rather than, with a leading ``!``, keeps). Patterns without an inner slash match at any depth;
    a trailing slash asks for something below."""
    ignores = not pattern.startswith("!")
    body = pattern.lstrip("!") if not ignores else pattern
    below = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    out, i = "", 0
    body = body.lstrip("/")
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 1 :]:
            end = body.index("]", i + 1)
            inner = body[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[:1] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return "(?s)" + ("^" if anchored else "(?:^|/)") + out + ("/.*$" if below else "$"), ignores


def patterns_of(lines: list[str]) -> list[str]:
    """The ignore patterns among lines: neither empty nor comments."""
    return [p for p in map(str.strip, lines) if p and not p.startswith("#")]


class FolderRules:
    """What ignore patterns say about whole folders, so that a walk need not enter them.

    A folder is passed by if a pattern ignores whatever may lie below it (it asks for something
    below the folder or one above, as ``build/`` and ``/out/**`` do) and no later pattern may keep
    a file there. Patterns are compared with the folder component by component."""

    def __init__(self, lines: list[str]):
        self.rules = []
        for p in patterns_of(lines):
            expression, ignores = glob_regex(p)
            body = p.removeprefix("!")
            whole = body.endswith(("/", "/**"))
            anchored = "/" in body.rstrip("/")
            parts = [x if x == "**" else re.compile(glob_regex("/" + x)[0]) for x in body.strip("/").split("/")]
            self.rules.append((ignores, re.compile(expression) if whole else None, parts if anchored else None))

    def passed_by(self, folder: str) -> bool:
        """``folder``: relative to the root, without slashes at its ends."""
        steps, out = folder.split("/"), False
        for ignores, whole, parts in self.rules:
            if ignores:
                out = out or whole is not None and whole.search(folder + "/") is not None
            elif out and self._may_reach(parts, steps):
                out = False
        return out

    @staticmethod
    def _may_reach(parts: list | None, steps: list[str]) -> bool:
        """Whether a pattern may match something below the folder of these steps."""
        if parts is None:  # a name at any depth
            return True
        for part, step in zip(parts, steps):
            if part == "**":
                return True
            if not part.search(step):
                return False
        return True


def ignored(relative: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches a path ignores it."""
    out = F.lit(False)
    for p in patterns_of(patterns):
        expression, ignores = glob_regex(p)
        out = F.when(relative.rlike(expression), F.lit(ignores)).otherwise(out)
    return out
