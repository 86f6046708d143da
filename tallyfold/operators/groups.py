"""Group assembly: keep ranking, accounting and views of groups.

A group's rows carry ``group_id`` (the least ``scan_seq`` of its files) and ``kind``; position 0 is the
keeper. What needs the keeper alone is one grouped aggregate; positions need a sort within the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE = ("path", "size", "modified", "created")
#: Files of a group in one nested row.
PAGE = 10_000


def keep_order(strategy: str) -> list[Column]:
    """The keeper comes first; ties go by path, then by scan order."""
    first = {"newest": [F.desc("modified")], "oldest": [F.asc("modified")], "largest": [F.desc("size")], "first": []}[strategy]
    return [*first, *([F.asc("path")] if first else []), F.asc("scan_seq")]


def keep_key(strategy: str) -> Column:
    """A struct whose least value is the keeper's."""
    lead = {"newest": [-F.col("modified")], "oldest": [F.col("modified")], "largest": [-F.col("size")], "first": []}[strategy]
    return F.struct(*lead, *([F.col("path")] if lead else []), F.col("scan_seq"))


def group_summary(members: DataFrame, strategy: str = "oldest") -> DataFrame:
    """A5: n_files, file_size (the keeper's), reclaimable (all others') and keeper of each group; no sort."""
    got = members.groupBy("group_id", "kind").agg(
        F.count("*").alias("n_files"), F.sum("size").alias("total"), F.min_by(F.struct("path", "size"), keep_key(strategy)).alias("k")
    )
    return got.select("group_id", "kind", "n_files", F.col("k.size").alias("file_size"), (F.col("total") - F.col("k.size")).alias("reclaimable"), F.col("k.path").alias("keeper"))


def ranked(members: DataFrame, strategy: str = "oldest") -> DataFrame:
    """The members with ``pos`` from 0 in keep order."""
    return members.withColumn("pos", F.row_number().over(Window.partitionBy("kind", "group_id").orderBy(*keep_order(strategy))) - 1)


def nested(members: DataFrame, strategy: str = "oldest", page: int = PAGE) -> DataFrame:
    """Groups as rows: files in keep order, kind, file_size and reclaimable, largest gain first (O1, O2).

    A display form: a group of more than ``page`` files has a row for each page of so many, numbered from 0, so no
    row grows with a group. ``members`` is the form to compute with.
    """
    rows = ranked(members, strategy).withColumn("page", F.floor(F.col("pos") / page))
    rows = rows.groupBy("group_id", "kind", "page").agg(F.array_sort(F.collect_list(F.struct("pos", *FILE))).alias("f"))
    files = F.transform("f", lambda x: F.struct(*(x[c].alias(c) for c in FILE)))
    rows = rows.select("group_id", "kind", "page", files.alias("files"))
    return by_gain(rows.join(group_summary(members, strategy).select("group_id", "kind", "file_size", "reclaimable"), ["group_id", "kind"]))


def by_gain(groups: DataFrame) -> DataFrame:
    """O2 with ties by kind and id."""
    return groups.orderBy(F.desc("reclaimable"), "kind", "group_id", *(["page"] if "page" in groups.columns else []))


def of_kind(groups: DataFrame, kind: str = "all") -> DataFrame:
    """F13."""
    return groups if kind == "all" else groups.where(F.col("kind") == kind)


def flat_rows(members: DataFrame, strategy: str = "oldest") -> DataFrame:
    """A row per file with is_ref, first_of_group and the group's row count as span."""
    span = F.count("*").over(Window.partitionBy("kind", "group_id"))
    rows = ranked(members, strategy).withColumn("span", span)
    return rows.withColumns({"is_ref": F.col("pos") == 0, "first_of_group": F.col("pos") == 0})


def totals(summary: DataFrame) -> DataFrame:
    """Groups, bytes to be gained and copies beyond the keeper."""
    return summary.agg(
        F.count("*").alias("n_groups"), F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("reclaimable"), F.coalesce(F.sum(F.col("n_files") - 1), F.lit(0)).alias("n_copies")
    )


def scan_totals(files: DataFrame) -> DataFrame:
    """A6."""
    return files.agg(F.count("*").alias("scanned_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("scanned_bytes"))


def members_of(files: DataFrame, components: DataFrame, kind: str) -> DataFrame:
    """A4: the files (by ``scan_seq``) of components (node, component), which have two members at least."""
    return files.join(components, files["scan_seq"] == components["node"]).drop("node").withColumnRenamed("component", "group_id").withColumn("kind", F.lit(kind))
