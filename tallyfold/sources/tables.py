"""The test tables as inputs of the operators: file inventories, names, songs, hashes, videos, folders, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.bits import threshold_bits
from tallyfold.functions.paths import ancestors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_docs(spark: SparkSession, sf_dir: str, content: bool = False) -> DataFrame:
    """A file for each document; the hash is made in the scan, so the text goes no further unless asked for."""
    d = F.col("doc_id")
    text = F.col("text").cast("binary")
    ext = F.when(d % 5 == 0, ".txt").when(d % 5 == 1, ".MD").when(d % 5 == 2, ".tmp").when(d % 5 == 3, ".html").otherwise("")
    path = F.concat(
        F.when(d % 17 == 0, "/corpus/Temp/").otherwise("/corpus/"), "source", F.lit("/"), "lang", F.lit("/"), F.when(d % 23 == 0, "~$").otherwise(""), F.lit("doc_"),
        F.lpad(d.cast("string"), 6, "0"), ext,
    )
    modified = F.lit(1_700_000_000) + (d * 7919) % 100_000
    return table(spark, sf_dir, "documents").select(
        d.alias("scan_seq"), path.alias("path"), F.octet_length("text").cast("bigint").alias("size"), modified.alias("modified"),
        F.when(d % 10 == 0, F.lit(0).cast("bigint")).otherwise(modified - (d % 7) * 3600).alias("created"), F.sha2(text, 256).alias("full_hash"), *([text.alias("content")] if content else []),
    )


def pages_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each page, by url."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("scan_seq"), F.col("url").alias("path"), F.octet_length("html").cast("bigint").alias("size"),
        F.lit(0).cast("bigint").alias("modified"), F.lit(0).cast("bigint").alias("created"),
    )


def part_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A song for each part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("scan_seq"), F.concat(F.lit("/music/"), F.col("p_partkey").cast("string"), F.lit(".mp3")).alias("path"), F.col("p_brand").alias("artist"),
        F.col("p_name").alias("title"), F.col("p_size").cast("bigint").alias("duration"), F.lit(1).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("modified"),
        F.lit(0).cast("bigint").alias("created"),
    )


def emb_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 63-bit hash for each embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scan_seq"), threshold_bits(F.col("embedding")).alias("phash"))


def emb_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two videos of fifteen frames, ten of them shared, for each twenty embeddings; every embedding is a frame."""
    v, k = F.col("scan_seq"), F.col("k")
    frames = emb_hashes(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).where((v % 20).between(5 * k, 5 * k + 14))
    frames = frames.select((F.expr("2 * (scan_seq div 20)") + k).alias("video"), v.alias("at"), "phash")
    sig = F.transform(F.array_sort(F.collect_list(F.struct("at", "phash"))), lambda x: x["phash"])
    return frames.groupBy("video").agg(sig.alias("sig")).select(F.col("video").alias("scan_seq"), "sig")


def dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders and files of ``files_docs``, with empty folders for each source."""
    files = files_docs(spark, sf_dir).select("path")
    src = table(spark, sf_dir, "documents").select("source").distinct()
    void = lambda *names: F.explode(F.array(*(F.concat(F.lit("/corpus/"), "source", F.lit(n)) for n in names)))
    made = src.select(void("", "/void", "/void/a", "/void/b").alias("path"))
    ini = src.where("CAST(substring(source, 4) AS INT) % 2 = 0").select(void("/void/a/desktop.ini").alias("path"))
    folders = files.select(F.explode(ancestors(F.col("path"))).alias("path")).union(made).distinct()
    row = lambda df, kind: df.select("path", F.lit(0).cast("bigint").alias("modified"), F.lit(0).cast("bigint").alias("created"), F.lit(kind).alias("entry_kind"), F.lit("/corpus").alias("root"))
    return row(folders, "dir").union(row(files.union(ini), "file"))


def scan_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for even files, and out-of-date ones for every sixth from 1."""
    f = files_docs(spark, sf_dir)
    s = F.col("scan_seq")
    rows = f.where((s % 2 == 0) | (s % 6 == 1)).withColumn("mtime", F.when(s % 2 == 0, F.col("modified")).otherwise(F.col("modified") - 1))
    return rows.select("path", "size", "mtime", F.substring("full_hash", 1, 32).alias("partial_hash"), "full_hash", F.lit(1).cast("bigint").alias("scanned_at"))
