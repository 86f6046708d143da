"""Exact duplicates by a funnel of size, partial hash and full hash.

Hashes are expressions in the scan, so contents are never shuffled: what is grouped is one short row per
file. ``funnel`` is the variant for files that are read by path: it reads nothing of a file whose size is
unique and no whole file whose head and tail are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.groups import keep_key
from tallyfold.plans.storage import write_table

#: From this size on the partial hash is of the size, the head and the tail.
LARGE, EDGE = 65_536, 4_096


def partial_text(size: Column, content: Column, large: int = LARGE, edge: int = EDGE) -> Column:
    """What the partial hash is of: all of a small content, else size, head and tail."""
    ends = F.concat(F.encode(F.concat(size.cast("string"), F.lit(":")), "UTF-8"), F.substring(content, 1, edge), F.substring(content, -edge, edge))
    return F.when(size < large, content).otherwise(ends)


def partial_hash(size: Column, content: Column, large: int = LARGE, edge: int = EDGE) -> Column:
    return F.md5(partial_text(size, content, large, edge))


def full_hash(content: Column) -> Column:
    """X21."""
    return F.sha2(content, 256)


def of_repeated(files: DataFrame, *keys: str) -> DataFrame:
    """The files whose keys repeat; the keys are written first, for a split of hot ones as in ``exact_members``."""
    return files.join(write_table(repeated(files, *keys).select(*keys), "repeated"), list(keys), "left_semi")


def repeated(files: DataFrame, *keys: str) -> DataFrame:
    """A1-A3: key values that two files or more have, with ``n``."""
    return files.groupBy(*keys).agg(F.count(keys[-1]).alias("n")).where("n > 1")


def exact_summary(files: DataFrame, strategy: str = "oldest", full: str = "full_hash") -> DataFrame:
    """The groups' accounting in one pass and one shuffle of short rows: no join back, no sort within a group.

    A null hash is counted as none, so that no filter on the hash is pushed into the scan and computes it twice.
    """
    got = files.groupBy("size", full).agg(F.count(full).alias("n_files"), F.min("scan_seq").alias("group_id"), F.min_by("path", keep_key(strategy)).alias("keeper")).where("n_files > 1")
    return got.select("group_id", F.lit("exact").alias("kind"), "n_files", F.col("size").alias("file_size"), (F.col("size") * (F.col("n_files") - 1)).alias("reclaimable"), "keeper")


def exact_members(files: DataFrame, full: str = "full_hash") -> DataFrame:
    """Files with another of equal size and hash, with group_id and kind; a null hash (unreadable) is in no group.

    ``files`` is read twice: where the hash is an expression over contents, write the short rows first. The groups
    are written before they are joined back, so that a group with a third of all files can be split.
    """
    groups = files.groupBy("size", full).agg(F.count(full).alias("__n"), F.min("scan_seq").alias("group_id")).where("__n > 1").drop("__n")
    groups = write_table(groups, "exact_groups")
    return files.join(groups, ["size", full]).withColumn("kind", F.lit("exact"))


def funnel(files: DataFrame, partial: Callable[[DataFrame], DataFrame], full: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Exact members of files that are read by path. ``partial`` and ``full`` add a hash column of that name + ``_hash``."""
    halved = write_table(partial(of_repeated(files, "size")), "partial")
    return exact_members(write_table(full(of_repeated(halved, "size", "partial_hash")), "full"))
