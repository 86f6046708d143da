"""A whole scan (R1): one lazy plan per kind, joined by tables that are written once."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.text import comparable_tag
from tallyfold.operators import cache as memo
from tallyfold.operators.components import connected_components
from tallyfold.operators.exact import exact_members, of_repeated
from tallyfold.operators.filters import has_extension, remaining
from tallyfold.operators.groups import members_of, nested, scan_totals
from tallyfold.operators.pairs import hash_links, music_links, name_links, video_links
from tallyfold.operators.tools import big_files, empty_folders, temp_files
from tallyfold.plans.options import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS, ScanOptions
from tallyfold.plans.storage import write_table
from tallyfold.sources.contents import full_hashed, partial_hashed
from tallyfold.sources.media import image_hashes, music_tags, video_signatures
from tallyfold.sources.walker import read_tree, scan_files

MEMBER = ("group_id", "kind", "path", "size", "modified", "created", "scan_seq")


@dataclass
class ScanResult:
    """members: a row per file in a group; tools: cleanup rows; summary: one row."""

    members: DataFrame
    tools: DataFrame
    summary: DataFrame
    options: ScanOptions

    @property
    def groups(self) -> DataFrame:
        """Nested groups, largest gain first."""
        return nested(self.members, self.options.keep_strategy)

    def write_json(self, folder: str) -> None:
        """S15."""
        for name in ("groups", "tools", "summary"):
            getattr(self, name).write.mode("overwrite").json(f"{folder}/{name}")


def _grouped(files: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    return members_of(files, connected_components(pairs), kind).select(*MEMBER)


def exact_scan(files: DataFrame, cache: memo.HashCache | None, now: int) -> tuple[DataFrame, DataFrame]:
    """C1 over files on disk: (members, one row of cache hits). Only files of a repeated size are opened."""
    same_size = of_repeated(files, "size")
    if cache is not None:
        same_size = memo.lookup(same_size, cache.read("scan_cache"), "partial_hash", "full_hash")
    else:
        same_size = same_size.withColumns({"partial_hash": F.lit(None).cast("string"), "full_hash": F.lit(None).cast("string"), "hit": F.lit(False)})
    halved = write_table(partial_hashed(same_size.withColumn("known", F.col("full_hash").isNotNull())), "partial")
    whole = write_table(full_hashed(of_repeated(halved, "size", "partial_hash")), "full")
    if cache is not None:
        done = halved.drop("full_hash").join(whole.select("path", "full_hash"), "path", "left")
        cache.put("scan_cache", done.select("path", "size", F.col("modified").alias("mtime"), "partial_hash", "full_hash", F.lit(now).cast("bigint").alias("scanned_at")))
    hits = halved.agg(F.count_if("hit").alias("p")).crossJoin(whole.agg(F.count_if("known").alias("f"))).select((F.col("p") + F.col("f")).alias("cache_hits"))  # one row each
    return exact_members(whole).select(*MEMBER), hits


def remembered(files: DataFrame, extensions: tuple[str, ...], cache: memo.HashCache | None, table: str, make: Callable[[DataFrame], DataFrame], now: int) -> DataFrame:
    """K4, K5: (scan_seq, value) of the files of a type, from the memo where path, size and time agree, else made and kept there."""
    value = memo.VALUE[table]
    if cache is None:
        return make(files)
    looked = write_table(memo.lookup(files.where(has_extension(F.col("path"), extensions)), cache.read(table), value), "looked_up")
    fresh = write_table(make(looked.where("NOT hit").drop(value, "hit")).select("scan_seq", value), "features")
    rows = looked.select("scan_seq", "path", "size", F.col("modified").alias("mtime")).join(fresh, "scan_seq")
    cache.put(table, rows.select("path", "size", "mtime", value, F.lit(now).cast("bigint").alias("scanned_at")))
    return looked.where("hit").select("scan_seq", value).union(fresh)


def scan(
    spark: SparkSession, options: ScanOptions, decode: Callable | None = None, read_tags: Callable | None = None, frames: Callable | None = None,
) -> ScanResult:
    """Collect, exact groups, similar groups of what is left, cleanup rows (on all collected files) and totals."""
    began = time.time()
    files = write_table(scan_files(spark, options), "files")
    cache = memo.HashCache(spark, options.cache_path) if options.use_cache and options.cache_path else None
    exact, hits = exact_scan(files, cache, int(began))
    exact = write_table(exact, "exact")
    left = write_table(remaining(files, exact), "remaining")
    kinds = [exact]
    if options.fuzzy_filename:
        kinds.append(_grouped(left, name_links(left, options.fuzzy_threshold, options.fuzzy_same_dir_only, options.max_bucket), "fuzzy_name"))
    if options.similar_images:
        hashes = remembered(left, IMAGE_EXTENSIONS, cache, "image_cache", lambda f: image_hashes(f, *([decode] if decode else [])), int(began))
        kinds.append(_grouped(left, hash_links(hashes, options.image_threshold), "similar_image"))
    if options.music_dedup:
        tags = write_table(music_tags(left, *([read_tags] if read_tags else [])), "tags").where(comparable_tag(F.col("artist"), F.col("title")))
        kinds.append(_grouped(left, music_links(tags, options.music_threshold), "music_tag"))
    if options.similar_videos:
        sigs = remembered(left, VIDEO_EXTENSIONS, cache, "video_cache", lambda f: video_signatures(f, options.ffmpeg_path, frames), int(began))
        kinds.append(_grouped(left, video_links(sigs, options.video_threshold), "similar_video"))
    members = reduce(DataFrame.unionByName, kinds)
    tools = [spark.createDataFrame([], "kind string, path string, size bigint, modified bigint, created bigint, detail string")]
    if options.tool_empty_folders:
        tools.append(empty_folders(read_tree(spark, options.paths, options.follow_symlinks, None if options.recursive else 1), options.recursive))
    if options.tool_big_files:
        tools.append(big_files(files, options.tool_big_files_count))
    if options.tool_temp_files:
        tools.append(temp_files(files))
    elapsed = F.lit(int((time.time() - began) * 1000)).cast("bigint").alias("elapsed_ms")
    summary = scan_totals(files).crossJoin(hits).select("*", elapsed)  # one row each
    return ScanResult(members, reduce(DataFrame.unionByName, tools), summary, options)

