"""Predicates over a file inventory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.paths import extension
from tallyfold.plans.options import ScanOptions


def has_extension(path: Column, extensions: tuple[str, ...]) -> Column:
    """False, not null, for a path without extension."""
    return F.coalesce(extension(path).isin([e.lower() for e in extensions]), F.lit(False))


def filter_files(files: DataFrame, options: ScanOptions) -> DataFrame:
    """The rows that pass every restriction of ``options``; those on size reach the scan."""
    tests = []
    if options.min_size > 0:
        tests.append(F.col("size") >= options.min_size)
    if options.max_size > 0:
        tests.append(F.col("size") <= options.max_size)
    tests += [~F.col("path").contains(p) for p in options.exclude_paths if p]
    if options.only_extensions:
        tests.append(has_extension(F.col("path"), options.only_extensions))
    if options.exclude_extensions:
        tests.append(~has_extension(F.col("path"), options.exclude_extensions))
    return files.where(reduce(lambda a, b: a & b, tests)) if tests else files


def remaining(files: DataFrame, members: DataFrame) -> DataFrame:
    """The files whose path is in none of the groups."""
    return files.join(members.select("path").distinct(), "path", "left_anti")
