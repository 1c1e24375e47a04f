"""Choosing files to remove from groups, and guards that a copy stays.

Members are rows (group_id, path, size, modified, rank_in_group, is_reference, ...). The file to
keep is chosen among all files of a group, references included; references leave the selection
only after that. What a group decides is an aggregate of it, and rows meet it by group and path, so
a group of any size spreads over all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.formatting import on_one_line, posix_quoted, powershell_quoted
from kindred.functions.paths import extension, parent, under
from kindred.operators.ranking import ranked
from kindred.plans.tables import bounded, materialize


def _but(members: DataFrame, kept: DataFrame) -> DataFrame:
    """Members other than ``kept`` (group_id, path), without references."""
    return members.filter(~F.col("is_reference")).join(kept, ["group_id", "path"], "left_anti")


def _one(members: DataFrame, path: Column) -> DataFrame:
    return members.groupBy("group_id").agg(path.alias("path"))


def duplicates(members: DataFrame) -> DataFrame:
    return members.filter((F.col("rank_in_group") > 1) & ~F.col("is_reference"))


def oldest(members: DataFrame) -> DataFrame:
    """All but the newest; of equally new ones the last stays."""
    return _but(members, _one(members, F.max_by("path", F.struct("modified", "rank_in_group"))))


def newest(members: DataFrame) -> DataFrame:
    """All but the oldest; of equally old ones the first stays."""
    return _but(members, _one(members, F.min_by("path", F.struct("modified", "rank_in_group"))))


smallest = largest = duplicates


def matching(members: DataFrame, match: Column) -> DataFrame:
    """The files that match; where a whole group does, its first match stays."""
    whole = members.groupBy("group_id").agg(F.min_by("path", "rank_in_group").alias("path"), F.min(F.coalesce(match, F.lit(False))).alias("_all")).filter("_all").drop("_all")
    return _but(members.filter(match), whole)


def by_extension(members: DataFrame, wanted: str) -> DataFrame:
    return matching(members, extension(F.col("path")) == wanted.lower().lstrip("."))


def by_directory(members: DataFrame, root: str) -> DataFrame:
    return matching(members, under(F.col("path"), F.lit(root)))


def by_group_name(members: DataFrame, name: str) -> DataFrame:
    return matching(members, F.col("group_name") == name)


def by_folder(members: DataFrame, folder: str) -> DataFrame:
    """The files of a group in one folder, unless that would take every file of the group."""
    hit = parent(F.col("path")) == folder
    whole = members.groupBy("group_id").agg(F.min(hit).alias("_all")).filter("_all").select("group_id")
    return members.filter(hit & ~F.col("is_reference")).join(bounded(materialize(whole, "whole_groups")), "group_id", "left_anti")


def apply(selected: DataFrame, more: DataFrame) -> DataFrame:
    """The selection with more paths in it."""
    return selected.select("path").union(more.select("path")).distinct()


def toggle(members: DataFrame, selected: DataFrame, paths: DataFrame) -> DataFrame:
    """The selection with each of ``paths`` in it taken out and each other one put in; references
    are refused."""
    free = members.filter(~F.col("is_reference")).select("path").join(paths.select("path"), "path", "left_semi")
    return selected.select("path").join(free, "path", "left_anti").union(free.join(selected, "path", "left_anti")).distinct()


class History:
    """Selections that can be undone, the last 50."""

    DEPTH = 50

    def __init__(self, selected: DataFrame):
        self.selected, self.past = selected, []

    def set(self, selected: DataFrame) -> None:
        self.past = [*self.past, self.selected][-self.DEPTH :]
        self.selected = selected

    def undo(self) -> bool:
        if self.past:
            self.selected = self.past.pop()
            return True
        return False


def deletion_plan(members: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Adds action (keep or delete): selected files, if any are; else, in groups with references,
    all other files; else all but the first."""
    if selected is not None:
        marked = members.join(selected.select("path").distinct().withColumn("_chosen", F.lit(True)), "path", "left")
        return marked.withColumn("action", F.when(F.col("_chosen"), "delete").otherwise("keep")).drop("_chosen")
    referenced = bounded(materialize(members.filter("is_reference").select("group_id").distinct(), "referenced")).withColumn("_referenced", F.lit(True))
    delete = F.when(F.col("_referenced"), ~F.col("is_reference")).otherwise(F.col("rank_in_group") > 1)
    return members.join(referenced, "group_id", "left").withColumn("action", F.when(delete, "delete").otherwise("keep")).drop("_referenced")


def without_survivor(members: DataFrame, selected: DataFrame) -> DataFrame:
    """group_id of groups that a selection would take whole; a deletion must refuse them."""
    left = members.select("group_id").distinct().join(members.join(selected, "path", "left_anti").select("group_id").distinct(), "group_id", "left_anti")
    return left


def after_delete(members: DataFrame, deleted: DataFrame) -> DataFrame:
    """Members that are left, in groups that still have two, ranked anew."""
    left = materialize(members.join(deleted.select("path").distinct(), "path", "left_anti").withColumnRenamed("rank_in_group", "_was"), "left")
    counts = materialize(left.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
    kept = left.join(bounded(counts.drop("n")), "group_id", "left_semi")
    return ranked(kept, ["group_id"], ["_was"], "rank_in_group", counts).drop("_was").select(*members.columns)


def filter_selected(members: DataFrame, selected: DataFrame) -> DataFrame:
    """Members that are selected; groups without any go."""
    return members.join(selected.select("path").distinct(), "path", "left_semi")


def selected_summary(members: DataFrame, selected: DataFrame) -> DataFrame:
    chosen = filter_selected(members, selected)
    zero = F.lit(0).cast("long")
    return chosen.agg(F.countDistinct("group_id").alias("duplicate_groups"), F.count(F.lit(1)).alias("duplicate_files"), F.coalesce(F.sum("size"), zero).alias("reclaimable_space"))


def script_lines(plan: DataFrame, kind: str = "posix", confirm: bool = False) -> DataFrame:
    """(group_id, rank_in_group, line): one command for each file, and a comment where it stays;
    without ``confirm`` deletions are only printed. Line ends in names stay inside their quotes, and
    comments have none."""
    quoted = posix_quoted if kind == "posix" else powershell_quoted
    command = {("posix", True): "rm -f -- ", ("posix", False): "echo rm -f -- ", ("powershell", True): "Remove-Item -LiteralPath ", ("powershell", False): "Write-Output Remove-Item -LiteralPath "}[kind, confirm]
    line = F.when(F.col("action") == "delete", F.concat(F.lit(command), quoted(F.col("path")))).otherwise(F.concat(F.lit("# keep "), quoted(on_one_line(F.col("path")))))
    return plan.select("group_id", "rank_in_group", line.alias("line"))
