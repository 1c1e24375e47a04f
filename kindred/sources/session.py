"""Saved sessions: JSON lines in parts, and a head with their checksum."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.schema import SESSION_VERSION
from kindred.sources.parts import PART_ROWS, folder_digest, read_text, write_text

_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


class SessionError(ValueError):
    """The file is no session, was changed, or is of another version."""


def groups_json(members: DataFrame) -> DataFrame:
    """(group_id, json): each group as a JSON object with its files in order."""
    files = F.transform(F.array_sort(F.collect_list(F.struct("rank_in_group", "path", "size"))), lambda f: F.struct(f["path"].alias("path"), f["size"].alias("size")))
    return members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total_size"), files.alias("files")).select("group_id", F.to_json(F.struct(F.col("group_id").alias("hash"), "n", "total_size", "files")).alias("json"))


@dataclass
class Session:
    """head: version, created_at, scan_paths, settings and counts; members (MEMBERS), selections
    (path)."""

    head: dict
    members: DataFrame
    selections: DataFrame


MEMBERS = "group_id string, rank_in_group int, path string, size long, modified timestamp, group_name string, is_similar boolean, is_reference boolean"


def save(path: str, members: DataFrame, selections: DataFrame, settings: dict, scan_paths: list[str], created_at: str) -> None:
    """Write a session as a folder: files of groups and selected paths as JSON lines, in order and
    written by tasks, and a head with one checksum for each of the two, a hash tree over their
    parts. The head comes last: without it there is no session, and one that is there is not
    overwritten. Columns of MEMBERS that the members do not have are null."""
    spark, path = members.sparkSession, path.rstrip("/")
    types = [c.split() for c in MEMBERS.split(", ")]
    rows = members.select(*[(F.col(n) if n in members.columns else F.lit(None)).cast(t).alias(n) for n, t in types])
    counted = rows.agg(F.count(F.lit(1)).alias("files"), F.countDistinct("group_id").alias("groups")).first()
    parts = 1 + counted["files"] // PART_ROWS
    rows.repartitionByRange(parts, "group_id", "rank_in_group").sortWithinPartitions("group_id", "rank_in_group").write.option("timestampFormat", _TIME).json(f"{path}/groups")
    picked = selections.select("path").distinct()
    picked.repartitionByRange(parts, "path").sortWithinPartitions("path").write.json(f"{path}/selections")
    body = {"version": SESSION_VERSION, "created_at": created_at, "scan_paths": scan_paths, "settings": settings, "groups": counted["groups"], "files": counted["files"]}
    sums = {name: folder_digest(spark, f"{path}/{name}") for name in ("groups", "selections")}
    write_text(spark, f"{path}/session.json", json.dumps({"checksum": _checksum(body, sums), "parts": sums, "session": body}, ensure_ascii=False))


def _checksum(body: dict, sums: dict) -> str:
    return hashlib.sha256(json.dumps([body, sums], separators=(",", ":"), sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def load(spark: SparkSession, path: str) -> Session:
    """Read a session and check it: the head by the driver, all parts by tasks."""
    path = path.rstrip("/")
    try:
        envelope = json.loads(read_text(spark, f"{path}/session.json"))
        body, sums, checksum = envelope["session"], envelope["parts"], envelope["checksum"]
    except (Py4JJavaError, ValueError, KeyError, TypeError) as e:
        raise SessionError(f"not a session: {path}") from e
    if _checksum(body, sums) != checksum or any(folder_digest(spark, f"{path}/{name}") != sums.get(name) for name in ("groups", "selections")):
        raise SessionError("the checksum does not match")
    if body.get("version") != SESSION_VERSION:
        raise SessionError(f"version {body.get('version')} instead of {SESSION_VERSION}")
    members = spark.read.schema(MEMBERS).option("timestampFormat", _TIME).json(f"{path}/groups")
    return Session(body, members, spark.read.schema("path string").json(f"{path}/selections"))
