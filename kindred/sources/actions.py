"""Carrying out a deletion plan on files that all executors can reach."""

from __future__ import annotations

import json
import os
import shutil
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.selection import without_survivor
from kindred.plans.tables import scratch

RESULT = "path string, size long, bytes_freed long, error string"


class UnsafePlan(ValueError):
    """A plan would leave no file of some group."""


#: Logs that intents are dealt to, by path.
LOGS = 256


def _log_of(path: str) -> int:
    return zlib.crc32(path.encode("utf-8", "surrogateescape")) % LOGS


class _Intents:
    """What attempts said of files: a line before a file is touched and one after. Each attempt
    writes to files of its own and reads those of all others on the same paths."""

    def __init__(self, folder: str):
        os.makedirs(folder, exist_ok=True)
        self.folder, self.name, self.names = folder, uuid.uuid4().hex, os.listdir(folder)
        self.logs: dict[int, tuple[dict, object]] = {}

    def _log(self, path: str) -> tuple[dict, object]:
        at = _log_of(path)
        if at not in self.logs:
            said = {}
            for name in (n for n in self.names if n.startswith(f"{at}-")):
                with open(os.path.join(self.folder, name), encoding="utf-8") as f:
                    for line in f:
                        if line.endswith("\n"):  # the last one may have been cut off
                            mark, of = json.loads(line)
                            said[of] = mark
            self.logs[at] = said, open(os.path.join(self.folder, f"{at}-{self.name}"), "a", encoding="utf-8")  # noqa: SIM115
        return self.logs[at]

    def said(self, path: str) -> str | None:
        """``planned`` or ``done``, or None."""
        return self._log(path)[0].get(path)

    def say(self, mark: str, path: str) -> None:
        said, out = self._log(path)
        out.write(json.dumps([mark, path]) + "\n")
        out.flush()
        os.fsync(out.fileno())
        said[path] = mark


def log_folder(spark: SparkSession) -> str:
    """A new folder for intents in the shared one, which must be a path that tasks can open."""
    folder = scratch(spark, "deletions")
    if not folder.startswith(("/", "file:")):
        raise ValueError("a log folder that tasks can open must be named, as spark.checkpoint.dir is none")
    return "/" + folder.removeprefix("file:").lstrip("/")


def delete_files(plan: DataFrame, trash: str | None = None, dry_run: bool = True, log: str | None = None) -> DataFrame:
    """(path, size, bytes_freed, error) of the plan's files marked ``delete`` (group_id, path, size,
    modified, action). A file is left alone if its size or time is no longer that of the scan, and
    one that fails does not stop the others. ``trash``: a folder that files are moved to instead;
    ``dry_run``: only check. Refuses a plan that takes all files of a group.

    Each task notes what it is about to do in ``log``, a folder that all tasks can open (one is made
    in the shared folder). A task that runs again after a lost executor finds there what was done
    and reports it as done: a file that is gone, and that an attempt set out to take, was taken.
    Running the result twice thus deletes nothing twice and tells the same both times."""
    spark = plan.sparkSession
    chosen = plan.filter("action = 'delete'")
    if without_survivor(plan, chosen.select("path").distinct()).limit(1).count():
        raise UnsafePlan("no file of a group would be left")
    folder = None if dry_run else log or log_folder(spark)

    def delete(batches):
        intents = _Intents(folder) if folder else None
        for batch in batches:
            out = []
            for path, size, modified in batch.itertuples(index=False, name=None):
                try:
                    if intents and intents.said(path) and not os.path.lexists(path):
                        out.append((path, size, size, None))
                        continue
                    s = os.lstat(path)
                    if s.st_size != size or (modified is not None and int(s.st_mtime) != modified):
                        raise OSError("changed since the scan")
                    if intents:
                        intents.say("planned", path)
                        if trash:
                            shutil.move(path, os.path.join(trash, f"{uuid.uuid4().hex}-{os.path.basename(path)}"))
                        else:
                            os.remove(path)
                        intents.say("done", path)
                    out.append((path, size, 0 if dry_run else size, None))
                except OSError as e:
                    out.append((path, size, 0, str(e)))
            yield pd.DataFrame(out, columns=["path", "size", "bytes_freed", "error"]).astype({"size": "int64", "bytes_freed": "int64"})

    files = chosen.groupBy("path").agg(F.first("size").alias("size"), F.unix_seconds(F.first("modified")).alias("modified"))
    files = files.repartition(LOGS, F.pmod(F.crc32("path"), F.lit(LOGS)))  # so that a task reads few logs
    return files.mapInPandas(delete, RESULT)
