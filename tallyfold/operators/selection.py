"""Selection over flat group rows (L1-L9): group_id, kind, path, size, modified, created, pos, checked.

A criterion is an expression over one row; what a group decides together is one window over its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.paths import file_name, is_under, path_depth

_group = lambda: Window.partitionBy("kind", "group_id")
_name = lambda: file_name(F.col("path"))
DAY = 86_400

#: L4a-L4j: the criterion's best value first.
KEEP = {
    "name_long": lambda: F.desc(F.length(_name())), "name_short": lambda: F.asc(F.length(_name())),
    "depth_deep": lambda: F.desc(path_depth(F.col("path"))), "depth_shallow": lambda: F.asc(path_depth(F.col("path"))),
    "created_new": lambda: F.desc("created"), "created_old": lambda: F.asc("created"),
    "modified_new": lambda: F.desc("modified"), "modified_old": lambda: F.asc("modified"),
    "path_long": lambda: F.desc(F.length("path")), "path_short": lambda: F.asc(F.length("path")),
}
FOLDER_KEEP = ("path_under_dir", "path_outside_dir")

_days = lambda n, now: F.lit((now // DAY - n) * DAY)
#: L5a-L5n: the rows that a value selects; ``now`` in seconds.
SELECT = {
    "name_ge": lambda v, now: F.length(_name()) >= v, "name_le": lambda v, now: F.length(_name()) <= v,
    "name_length_ge": lambda v, now: F.length("path") >= v, "name_length_le": lambda v, now: F.length("path") <= v,
    "depth_ge": lambda v, now: path_depth(F.col("path")) >= v, "depth_le": lambda v, now: path_depth(F.col("path")) <= v,
    "created_before": lambda v, now: (F.col("created") > 0) & (F.col("created") < _days(v, now)),
    "created_after": lambda v, now: (F.col("created") > 0) & (F.col("created") > _days(v, now)),
    "modified_before": lambda v, now: (F.col("modified") > 0) & (F.col("modified") < _days(v, now)),
    "modified_after": lambda v, now: (F.col("modified") > 0) & (F.col("modified") > _days(v, now)),
    "name_contains": lambda v, now: F.lower(_name()).contains(v.lower()), "name_not_contains": lambda v, now: ~F.lower(_name()).contains(v.lower()),
    "path_under_dir": lambda v, now: is_under(F.col("path"), v), "path_outside_dir": lambda v, now: ~is_under(F.col("path"), v),
}


def default_selection(rows: DataFrame) -> DataFrame:
    """L1: all but the keeper."""
    return rows.withColumn("checked", F.col("pos") > 0)


def _where(rows: DataFrame, value: Column, visible: Column | None) -> DataFrame:
    return rows.withColumn("checked", value if visible is None else F.when(visible, value).otherwise(F.col("checked")))


def select_all(rows: DataFrame, visible: Column | None = None) -> DataFrame:
    """L2."""
    return _where(rows, F.lit(True), visible)


def select_none(rows: DataFrame, visible: Column | None = None) -> DataFrame:
    """L2."""
    return _where(rows, F.lit(False), visible)


def invert(rows: DataFrame, visible: Column | None = None) -> DataFrame:
    """L2, U5."""
    return _where(rows, ~F.col("checked"), visible)


def toggle_file(rows: DataFrame, group_id: int, path: str) -> DataFrame:
    """L3, U4: one file of one group."""
    return _where(rows, ~F.col("checked"), (F.col("group_id") == group_id) & (F.col("path") == path))


def toggle_group(rows: DataFrame, group_id: int) -> DataFrame:
    """L3: all of a group, or none where all were."""
    every = F.bool_and("checked").over(_group())
    return _where(rows, ~every, F.col("group_id") == group_id)


def keep_by(rows: DataFrame, criterion: str, folder: str | None = None) -> DataFrame:
    """L4: checks all but what the criterion keeps, in every group; a group it keeps nothing of is kept whole.

    A ranking keeps one row, the first by ``pos`` of equals; a folder criterion keeps all that match.
    """
    if criterion in FOLDER_KEEP:
        if folder is None:
            raise ValueError("a folder is needed")
        match = is_under(F.col("path"), folder)
        match = match if criterion == "path_under_dir" else ~match
        rows = rows.withColumn("__m", match)
        return rows.withColumn("checked", F.bool_or("__m").over(_group()) & ~F.col("__m")).drop("__m")
    best = F.row_number().over(_group().orderBy(KEEP[criterion](), F.asc("pos")))
    return rows.withColumn("checked", best > 1)


def select_by(rows: DataFrame, criterion: str, value: object, now: int | None = None) -> DataFrame:
    """Checks what matches, and nothing else."""
    if criterion in FOLDER_KEEP and not value:
        raise ValueError("a folder is needed")
    return rows.withColumn("checked", F.coalesce(SELECT[criterion](value, now), F.lit(False)))


def checked_items(rows: DataFrame, visible: Column | None = None) -> DataFrame:
    """The checked rows with is_ref and the group's keeper as reference."""
    keeper = F.min_by("path", "pos").over(_group())
    items = rows.withColumn("reference", keeper).where(F.col("checked") & (F.lit(True) if visible is None else visible))
    return items.withColumn("is_ref", F.col("pos") == 0)


def checked_count(rows: DataFrame) -> DataFrame:
    """A10."""
    return rows.agg(F.count_if("checked").alias("n_checked"))


def after_actions(rows: DataFrame, results: DataFrame, kind: str) -> DataFrame:
    """Rows without the paths that succeeded, without groups of fewer than two, checked anew; a copy moves nothing."""
    if kind == "copy":
        return default_selection(rows)
    left = rows.join(results.where("ok").select("path").distinct(), "path", "left_anti")
    left = left.withColumn("__n", F.count("*").over(_group())).where("__n > 1").drop("__n")
    return default_selection(left.withColumn("pos", F.row_number().over(_group().orderBy("pos")) - 1))
