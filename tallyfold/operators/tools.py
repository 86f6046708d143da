"""Cleanup queries (T1-T3): kind, path, size, modified, created, detail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.display import megabytes
from tallyfold.functions.paths import ancestors, extension, lower_name, parent_dir
from tallyfold.plans.options import IGNORABLE_NAMES, TEMP_EXTENSIONS

#: Why a file counts as temporary; folder spellings, in this case only.
LOCK_FILE, IN_TEMP, TEMP_TYPE = "Office 临时锁定文件", "位于临时目录", "临时文件扩展名 ."
TEMP_DIRS = ("\\Temp\\", "/Temp/", "\\TEMP\\")
EMPTY_DETAIL = "空文件夹"
SHOWN = ("kind", "path", "size", "modified", "created", "detail")


def big_files(files: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` largest files of more than 0 bytes, ties in scan order."""
    top = files.where("size > 0").orderBy(F.desc("size"), "scan_seq").limit(max(1, n))
    return top.withColumns({"kind": F.lit("big_file"), "detail": megabytes(F.col("size"))}).select(*SHOWN)


def temp_files(files: DataFrame) -> DataFrame:
    """Lock files, files under a temporary folder and files of a temporary type, the first reason named."""
    path = F.col("path")
    lock = lower_name(path).startswith("~$")
    inside = path.contains(TEMP_DIRS[0]) | path.contains(TEMP_DIRS[1]) | path.contains(TEMP_DIRS[2])
    typed = F.coalesce(extension(path).isin(*TEMP_EXTENSIONS), F.lit(False))
    why = F.when(lock, LOCK_FILE).when(inside, IN_TEMP).otherwise(F.concat(F.lit(TEMP_TYPE), extension(path)))
    return files.where(lock | inside | typed).withColumns({"kind": F.lit("temp_file"), "detail": why}).select(*SHOWN)


def empty_folders(tree: DataFrame, recursive: bool = True) -> DataFrame:
    """The topmost folders with no file below them but ignorable ones.

    ``tree`` has path, entry_kind (dir, file or link), root, modified and created; a link counts as a file. Only roots
    are looked at unless ``recursive``. Each file names its ancestors once; nothing is gathered per folder.
    """
    dirs = tree.where("entry_kind = 'dir'")
    solid = tree.where((F.col("entry_kind") == "link") | ((F.col("entry_kind") == "file") & ~lower_name(F.col("path")).isin(*IGNORABLE_NAMES)))
    full = solid.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    empty = dirs.join(full, "path", "left_anti")
    if not recursive:
        empty = empty.where(F.col("path") == F.col("root"))
    above = empty.select(F.col("path").alias("up"))
    top = empty.join(above, parent_dir(empty["path"]) == above["up"], "left_anti")
    return top.select(F.lit("empty_folder").alias("kind"), "path", F.lit(0).cast("bigint").alias("size"), "modified", "created", F.lit(EMPTY_DETAIL).alias("detail"))


def tools_of_kind(tools: DataFrame, kind: str) -> DataFrame:
    """F15."""
    return tools.where(F.col("kind") == kind)
