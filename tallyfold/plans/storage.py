"""Intermediate tables that outlive a lost executor.

Lineage is cut with Parquet tables in the folder that ``spark.checkpoint.dir`` names, which the driver
and all executors share. Only a session in local mode without that setting gets a folder of its own.
A table lives until ``drop_table``, or until the ``stored`` result that it was written for is there.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; an error on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"/tmp/checkpoints/tallyfold-{os.getpid()}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for block in _open[-1:]:
        block.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a reader that ``write_table`` returned and that nothing uses any more."""
    spark = df.sparkSession
    top = shared_dir(spark).split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if top in folder:
            _delete(spark, folder)


def stored(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``make`` as a written table, without the tables that were written on the way to it."""
    _open.append([])
    try:
        out = make()
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
    finally:
        for gone in _open.pop():
            _delete(spark, gone)
    for block in _open[-1:]:
        block.append(path)
    return spark.read.schema(out.schema).parquet(path)
