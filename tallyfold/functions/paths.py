"""Path expressions. Both ``/`` and ``\\`` separate; a path is text, never looked up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how a file without a type is shown.
NO_TYPE = "文件"


def parent_dir(path: Column) -> Column:
    """What stands before the last separator, empty without one."""
    return F.regexp_extract(path, r"(?s)^(.*)[/\\]", 1)


def base_name(path: Column) -> Column:
    """What follows the last separator."""
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def lower_name(path: Column) -> Column:
    """The last component in lower case."""
    return F.lower(base_name(path))


def extension(path: Column) -> Column:
    """lower-cased text after the last dot; null for none or a leading dot alone, empty for a trailing dot."""
    name = base_name(path)
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)))


def file_name(path: Column) -> Column:
    """The last component, or the whole path where it is empty."""
    name = base_name(path)
    return F.when(name == "", path).otherwise(name)


def path_depth(path: Column) -> Column:
    """X11: the number of separators."""
    return F.regexp_count(path, F.lit(r"[/\\]")).cast("int")


def file_type(path: Column) -> Column:
    """The upper-cased extension, or ``NO_TYPE``."""
    name = file_name(path)
    return F.when(name.rlike(r"(?s)^.+\.[^.]+$"), F.upper(F.regexp_extract(name, r"\.([^.]+)$", 1))).otherwise(NO_TYPE)


def is_under(path: Column, folder: str | None) -> Column:
    """In ``folder`` or ``folder`` itself, in any case; false without a folder."""
    if folder is None:
        return F.lit(False)
    at, low = folder.lower(), F.lower(path)
    return F.coalesce((low == at) | low.startswith(at + "/") | low.startswith(at + "\\"), F.lit(False))


def ancestors(path: Column) -> Column:
    """Every folder above ``path``, from the top, without the root itself."""
    parts = F.split(path, "/")
    upto = lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    return F.when(F.size(parts) > 2, F.transform(F.sequence(F.lit(2), F.size(parts) - 1), upto)).otherwise(F.array().cast("array<string>"))
