"""The options record, kinds and schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("modified", T.LongType()), T.StructField("created", T.LongType())])
#: Kinds of groups and cleanup rows, and keep strategies.
KINDS = ("exact", "fuzzy_name", "similar_image", "music_tag", "similar_video")
TOOL_KINDS = ("empty_folder", "big_file", "temp_file")
KEEP_STRATEGIES = ("newest", "oldest", "largest", "first")

#: File types and names.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "ico")
MUSIC_EXTENSIONS = ("mp3", "flac", "m4a", "aac", "ogg", "opus", "wma", "wav", "ape", "wv")
VIDEO_EXTENSIONS = ("mp4", "mkv", "avi", "mov", "wmv", "flv", "webm", "ts", "m4v", "mpg", "mpeg", "3gp", "m2ts", "rmvb")
TEMP_EXTENSIONS = ("tmp", "temp", "crdownload", "part", "partial", "download", "swp", "lock", "dmp", "bak~", "cache")
IGNORABLE_NAMES = ("desktop.ini", "thumbs.db", ".ds_store")


@dataclass(frozen=True)
class ScanOptions:
    """A scan request; thresholds in percent or bits, sizes in bytes, 0 for no bound."""

    paths: tuple[str, ...] = ()
    recursive: bool = True
    min_size: int = 0
    max_size: int = 0
    only_extensions: tuple[str, ...] = ()
    exclude_extensions: tuple[str, ...] = ()
    exclude_paths: tuple[str, ...] = ()
    follow_symlinks: bool = False
    max_depth: int | None = None
    keep_strategy: str = "oldest"
    use_cache: bool = False
    cache_path: str = ""
    fuzzy_filename: bool = False
    fuzzy_threshold: int = 80
    fuzzy_same_dir_only: bool = True
    max_bucket: int | None = None
    similar_images: bool = False
    image_threshold: int = 10
    music_dedup: bool = False
    music_threshold: int = 80
    similar_videos: bool = False
    video_threshold: int = 10
    ffmpeg_path: str = ""
    tool_empty_folders: bool = False
    tool_big_files: bool = False
    tool_big_files_count: int = 50
    tool_temp_files: bool = False

    def __post_init__(self) -> None:
        if self.keep_strategy not in KEEP_STRATEGIES:
            raise ValueError(f"keep_strategy is one of {KEEP_STRATEGIES}")
        clamp = lambda name, lo, hi: object.__setattr__(self, name, min(max(getattr(self, name), lo), hi))
        clamp("fuzzy_threshold", 1, 100)
        clamp("music_threshold", 1, 100)
        clamp("image_threshold", 0, 64)
        clamp("video_threshold", 0, 64)
        object.__setattr__(self, "tool_big_files_count", max(1, self.tool_big_files_count))
