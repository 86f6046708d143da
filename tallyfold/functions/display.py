"""Labels and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of kinds and rows.
KIND_LABELS = {"exact": "精确重复", "fuzzy_name": "文件名模糊", "similar_image": "相似图片", "music_tag": "音乐重复", "similar_video": "相似视频"}
TOOL_LABELS = {"empty_folder": "空文件夹", "big_file": "大文件", "temp_file": "临时文件"}
DELETE, KEEP = "删除", "保留"


def _labelled(kind: Column, labels: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), kind)


def kind_label(kind: Column) -> Column:
    """F16 for groups."""
    return _labelled(kind, KIND_LABELS)


def tool_label(kind: Column) -> Column:
    """F16 for cleanup rows."""
    return _labelled(kind, TOOL_LABELS)


def status_label(checked: Column) -> Column:
    """F17."""
    return F.when(checked, DELETE).otherwise(KEEP)


def format_bytes(n: Column) -> Column:
    """Bytes below 1024, else the largest of KB to PB, without decimals from 100 up."""
    out = F.format_string("%d B", n)
    for power, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        v = n / float(1024**power)
        shown = F.when(v >= 100, F.format_string("%.0f " + unit, v)).otherwise(F.format_string("%.1f " + unit, v))
        out = F.when(n >= 1024**power, shown).otherwise(out)
    return out


def format_date(seconds: Column) -> Column:
    """Minutes in the session's time zone; ``-`` for 0 or null."""
    shown = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm")
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "-").otherwise(shown)


def megabytes(size: Column) -> Column:
    """X18."""
    return F.format_string("%.1f MB", size / 1048576.0)
