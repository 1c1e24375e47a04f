"""Exports: CSV rows, JSON, HTML, scripts."""

from __future__ import annotations

import html
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.formatting import format_size, html_escaped, json_string, rfc3339
from kindred.functions.paths import in_category
from kindred.operators.ranking import numbered
from kindred.operators.selection import script_lines
from kindred.plans.tables import bounded, materialize
from kindred.schema import EXIT_CODES
from kindred.sources.images import thumbnail
from kindred.sources.parts import write_document


def csv_rows(members: DataFrame) -> DataFrame:
    """One row per file: group_id (a number from 1, by hash), hash, path, size of the group's first
    file, modified. Groups are numbered on their own, one row each."""
    heads = members.groupBy("group_id").agg(F.min_by("size", "rank_in_group").alias("size"))
    heads = heads.join(numbered(members, "group_id", "_n"), "group_id")
    return members.drop("size").join(heads, "group_id").select(F.col("_n").cast("long").alias("group_id"), F.col("group_id").alias("hash"), "path", "size", rfc3339(F.col("modified")).alias("modified"))


def write_csv(members: DataFrame, path: str) -> None:
    csv_rows(members).orderBy("group_id", "path").write.csv(path, header=True)


def json_groups(members: DataFrame) -> DataFrame:
    """(hash, json): hash, size and paths of each group."""
    paths = F.transform(F.array_sort(F.collect_list(F.struct("rank_in_group", "path"))), lambda f: f["path"])
    return members.groupBy("group_id").agg(F.min_by("size", "rank_in_group").alias("size"), paths.alias("files")).select(F.col("group_id").alias("hash"), F.to_json(F.struct(F.col("group_id").alias("hash"), "size", "files")).alias("json"))


def _with_ends(members: DataFrame) -> DataFrame:
    """Adds ``_n``, the number of files of the group, ``_size``, that of its first file, and
    ``_first``: whether it is the first group. No group meets in one row or task for it."""
    heads = materialize(members.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n"), F.min_by("size", "rank_in_group").alias("_size")), "heads")
    first = heads.agg(F.min("group_id")).first()[0]
    return members.join(bounded(heads), "group_id").withColumn("_first", F.col("group_id") == F.lit(first))


def json_lines(members: DataFrame) -> DataFrame:
    """(group_id, rank_in_group, line): the groups as one JSON array without its brackets, a line for
    each file; the lines of the first and the last file open and close its group."""
    rows = _with_ends(members)
    opens = F.concat(F.when(F.col("_first"), "").otherwise(","), F.lit('{"hash":'), json_string(F.col("group_id")), F.lit(',"size":'), F.col("_size").cast("string"), F.lit(',"files":['))
    line = F.concat(F.when(F.col("rank_in_group") == 1, opens).otherwise(","), json_string(F.col("path")), F.when(F.col("rank_in_group") == F.col("_n"), "]}").otherwise(""))
    return rows.select("group_id", "rank_in_group", line.alias("line"))


def write_json(members: DataFrame, summary: DataFrame, path: str, config: dict, timestamp: str) -> None:
    """One JSON document: metadata, groups by hash, summary."""
    head = {"version": "1", "timestamp": timestamp, "schema_version": "1.0", "config": config}
    head, tail = f'{{"metadata":{json.dumps(head)},"duplicates":[\n', f'],"summary":{json.dumps(summary.first().asDict())}}}\n'
    write_document(json_lines(members), ["group_id", "rank_in_group"], "line", path, head, tail)


def summary_lines(summary: dict) -> list[str]:
    """The summary for people: sizes and counts, and what the cache saved, where it did."""
    lines = [
        "Scan Summary", f"  {'Total files:':<18} {summary['total_files']}", f"  {'Total size:':<18} {shown_size(summary['total_size'])}",
        f"  {'Duplicates found:':<18} {summary['duplicate_files']} (in {summary['duplicate_groups']} groups)", f"  {'Reclaimable:':<18} {shown_size(summary['reclaimable_space'])}",
    ]
    hits = [(label, summary[k]) for label, k in (("Prehash hits:", "cache_prehash_hits"), ("Full hash hits:", "cache_fullhash_hits")) if summary.get(k)]
    return lines + ["Cache Effectiveness"] * bool(hits) + [f"  {label:<18} {n}" for label, n in hits]


def shown_size(size: int) -> str:
    for power, name in ((40, "TB"), (30, "GB"), (20, "MB"), (10, "KB")):
        if size >= 1 << power:
            return f"{size / (1 << power):.2f} {name}"
    return f"{size} B"


#: Bytes of an image that is made a thumbnail at most.
THUMBNAIL_BYTES = 64 << 20


def pictures(embed: bool, most: int):
    """A column function from the path of an image to a thumbnail for a page, decoded by tasks, or to
    a link; empty where it cannot be decoded or read."""
    def picture(path: str | None) -> str:
        if path is None:
            return ""
        if not embed:
            return f"<img loading=lazy height={most} src=\"{html.escape('file:///' + path.replace(chr(92), '/').lstrip('/'))}\">"
        try:
            with open(path, "rb") as f:
                uri = thumbnail(f.read(THUMBNAIL_BYTES), most)
        except OSError:
            return ""
        return f'<img src="{uri}">' if uri else ""

    @F.pandas_udf("string")
    def of(paths: pd.Series) -> pd.Series:
        return pd.Series([picture(p) for p in paths], dtype=object)

    return of


def html_lines(members: DataFrame, thumbnails: bool = False, embed: bool = True, pixels: int = 100) -> DataFrame:
    """(group_id, rank_in_group, line): a table for each group, a line for each of its files."""
    rows = _with_ends(members)
    image = F.lit("")
    if thumbnails:
        image = F.coalesce(pictures(embed, pixels)(F.when(in_category(F.col("path"), "images"), F.col("path"))), F.lit(""))
    mark = F.when(F.col("is_reference"), " (reference)").otherwise("") if "is_reference" in members.columns else F.lit("")
    opens = F.concat(F.lit("<h2><code>"), html_escaped(F.col("group_id")), F.lit("</code> "), format_size(F.col("_size")), F.lit("</h2><table>"))
    row = F.concat(F.lit("<tr><td>"), image, html_escaped(F.col("path")), mark, F.lit("</td><td>"), F.col("size").cast("string"), F.lit("</td></tr>"))
    line = F.concat(F.when(F.col("rank_in_group") == 1, opens).otherwise(""), row, F.when(F.col("rank_in_group") == F.col("_n"), "</table>").otherwise(""))
    return rows.select("group_id", "rank_in_group", line.alias("line"))


def write_html(members: DataFrame, summary: DataFrame, path: str, title: str = "Duplicate files", phases: dict[str, str] | None = None, thumbnails: bool = False, embed: bool = True, pixels: int = 100) -> None:
    """A page with a card for each figure of the summary, a table of phases and their durations and
    a table for each group; references are marked, images shown if asked for."""
    head = f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><style>.card{{display:inline-block;margin:4px;padding:8px;border:1px solid #ccc}}</style><h1>{html.escape(title)}</h1>"
    for k, v in summary.first().asDict().items():
        head += f"<div class=card><b>{html.escape(k.replace('_', ' '))}</b><br>{html.escape(shown_size(v) if k in ('total_size', 'reclaimable_space') else str(v))}</div>"
    if phases:
        head += "<table>" + "".join(f"<tr><td>{html.escape(k)}</td><td>{html.escape(v)}</td></tr>" for k, v in phases.items()) + "</table>"
    write_document(html_lines(members, thumbnails, embed, pixels), ["group_id", "rank_in_group"], "line", path, head + "\n")


def write_script(plan: DataFrame, path: str, kind: str = "posix", confirm: bool = False) -> None:
    head = ["#!/bin/sh", "set -eu"] if kind == "posix" else ["$ErrorActionPreference = 'Stop'"]
    write_document(script_lines(plan, kind, confirm), ["group_id", "rank_in_group"], "line", path, "\n".join(head) + "\n")


def outcome(errors: int, groups: int, interrupted: bool = False) -> str:
    return "interrupted" if interrupted else "partial" if errors else "success" if groups else "no_duplicates"


def exit_code(errors: int, groups: int, interrupted: bool = False) -> int:
    return EXIT_CODES[outcome(errors, groups, interrupted)][0]


def error_json(message: str, kind: str = "error") -> str:
    """An error for programs: code, exit code, message and whether the scan was interrupted."""
    number, code = EXIT_CODES[kind]
    return json.dumps({"code": code, "exit_code": number, "message": message, "interrupted": kind == "interrupted"})
