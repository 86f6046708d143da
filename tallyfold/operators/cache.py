"""Hash memo tables (K1-K8): Parquet instead of an embedded database.

A row holds for one path, size and modification time; after a change nothing of the old row is used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SCAN = "path string, size bigint, mtime bigint, partial_hash string, full_hash string, scanned_at bigint"
IMAGE = "path string, size bigint, mtime bigint, phash bigint, scanned_at bigint"
VIDEO = "path string, size bigint, mtime bigint, sig array<bigint>, scanned_at bigint"
#: What the media tables hold (K4, K5).
VALUE = {"image_cache": "phash", "video_cache": "sig"}
TABLES = {"scan_cache": SCAN, "image_cache": IMAGE, "video_cache": VIDEO}


def lookup(files: DataFrame, cache: DataFrame, *values: str) -> DataFrame:
    """The files with the cached ``values``, null unless path, size and time agree, and ``hit``."""
    own = cache.select("path", F.col("size").alias("__size"), F.col("mtime").alias("__mtime"), *(F.col(v).alias(f"__{v}") for v in values))
    fits = (F.col("__size") == F.col("size")) & (F.col("__mtime") == F.col("modified"))
    got = files.join(own, "path", "left").withColumns({v: F.when(fits, F.col(f"__{v}")) for v in values})
    hit = F.coalesce(fits & reduce(lambda a, b: a | b, (F.col(f"__{v}").isNotNull() for v in values)), F.lit(False))
    return got.withColumn("hit", hit).drop("__size", "__mtime", *(f"__{v}" for v in values))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """K3-K5: one row per path; ``new`` wins, and a null of it keeps the old value only if size and time are unchanged."""
    values = [c for c in old.columns if c not in ("path", "size", "mtime", "scanned_at")]
    n = new.select("path", F.struct("size", "mtime", "scanned_at", *values).alias("n"))
    o = old.select("path", F.struct("size", "mtime", "scanned_at", *values).alias("o"))
    same = (F.col("o.size") == F.col("n.size")) & (F.col("o.mtime") == F.col("n.mtime"))
    pick = {v: F.when(F.col("n").isNull(), F.col(f"o.{v}")).when(same, F.coalesce(F.col(f"n.{v}"), F.col(f"o.{v}"))).otherwise(F.col(f"n.{v}")) for v in values}
    keys = {k: F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")) for k in ("size", "mtime", "scanned_at")}
    return o.join(n, "path", "full").select("path", *(x.alias(c) for c, x in (keys | pick).items())).select(*old.columns)


def hits(looked_up: DataFrame) -> DataFrame:
    """A7."""
    return looked_up.agg(F.count_if("hit").alias("cache_hits"))


def row_count(*tables: DataFrame) -> DataFrame:
    """Rows of all tables."""
    counts = [t.agg(F.count("*").alias("n")) for t in tables]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out.agg(F.sum("n").alias("n_rows"))


class HashCache:
    """The tables under one folder. A write makes a new version and then names it current, so readers see whole versions."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, table: str) -> list[int]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            return []
        done = [s.getPath() for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done)

    def read(self, table: str) -> DataFrame:
        """K1: an empty table where there is none yet, or where it can't be read."""
        versions = self._versions(table)
        try:
            if versions:
                return self.spark.read.schema(TABLES[table]).parquet(f"{self.folder}/{table}/v{versions[-1]}")
        except AnalysisException:
            pass
        return self.spark.createDataFrame([], TABLES[table])

    def write(self, table: str, rows: DataFrame) -> None:
        """K6: one write a scan."""
        versions = self._versions(table)
        rows.write.parquet(f"{self.folder}/{table}/v{(versions or [0])[-1] + 1}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for old in versions[:-1]:  # the version before this one stays for readers that still use it
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/v{old}")
            path.getFileSystem(conf).delete(path, True)

    def put(self, table: str, rows: DataFrame) -> None:
        self.write(table, merge(self.read(table), rows))

    def count(self) -> int:
        """K8."""
        return row_count(*map(self.read, TABLES)).first()["n_rows"]

    def clear(self) -> int:
        """K7: the rows there were."""
        n = self.count()
        for table, schema in TABLES.items():
            self.write(table, self.spark.createDataFrame([], schema))
        return n
