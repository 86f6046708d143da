"""File inventories from directory trees (S1-S4, S14), as a Python data source.

The built-in binary reader leaves out names that begin with ``.`` or ``_`` and knows no creation time,
so the tree is walked: breadth first on the driver until there are PARTS folders, each of which is then a partition.
One folder's own entries are one listing. Only metadata are read here; contents are read later, by path, for the
few files that need it.
"""

from __future__ import annotations

import ctypes
import functools
import os
import stat
import struct
from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyfold.operators.filters import filter_files
from tallyfold.plans.options import ScanOptions

#: Folders that are walked as a partition each, at most about so many.
PARTS = 512
TREE = "path string, size bigint, modified bigint, created bigint, entry_kind string, root string"


def check_roots(paths: tuple[str, ...]) -> None:
    """S2."""
    for p in paths:
        if not os.path.exists(p):
            raise ValueError(f"no such path: {p}")
        if not os.path.isdir(p):
            raise ValueError(f"not a folder: {p}")


#: statx: the current folder, don't follow links, birth time wanted; where the mask and the time stand in its record.
_AT_CWD, _NO_FOLLOW, _BIRTH, _MASK_AT, _BIRTH_AT = -100, 0x100, 0x800, 0, 80


@functools.cache
def _statx() -> Callable | None:
    try:
        return ctypes.CDLL(None, use_errno=True).statx
    except (AttributeError, OSError):
        return None


def birth_time(path: str, follow: bool, seen: os.stat_result) -> int:
    """When the file was made, in whole seconds; 0 where neither ``stat`` nor ``statx`` knows."""
    born = getattr(seen, "st_birthtime", None)
    if born is None and (call := _statx()) is not None:
        record = ctypes.create_string_buffer(256)
        if call(_AT_CWD, os.fsencode(path), 0 if follow else _NO_FOLLOW, _BIRTH, record) == 0 and struct.unpack_from("<I", record, _MASK_AT)[0] & _BIRTH:
            born = struct.unpack_from("<q", record, _BIRTH_AT)[0]
    return max(0, int(born or 0))


def _row(path: str, root: str, follow: bool) -> tuple | None:
    """Whole seconds, 0 where unknown; None for what can't be read or is neither file, link nor folder."""
    try:
        s = os.stat(path, follow_symlinks=follow)
    except OSError:
        return None
    kind = "dir" if stat.S_ISDIR(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else "link" if stat.S_ISLNK(s.st_mode) else None
    return kind and (path, s.st_size if kind == "file" else 0, max(0, int(s.st_mtime)), birth_time(path, follow, s), kind, root)


class _Part(InputPartition):
    """A folder's own entries, or with ``deep`` all below it; ``seen`` are the folders that lead to it."""

    def __init__(self, root: str, top: str, depth: int, seen: frozenset, deep: bool):
        super().__init__((root, top, depth, seen, deep))
        self.root, self.top, self.depth, self.seen, self.deep = root, top, depth, seen, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [p for p in options.get("roots", "").split("\n") if p]
        self.follow = options.get("followsymlinks", "false") == "true"
        depth = options.get("maxdepth", "")
        self.depth = int(depth) if depth else None

    def _below(self, folder: str, depth: int, seen: frozenset) -> list[tuple[str, int, frozenset]]:
        """The folders in ``folder`` that are still to be entered; a link that leads back up is not."""
        if self.depth is not None and depth >= self.depth:
            return []
        try:
            with os.scandir(folder) as found:
                paths = sorted(e.path for e in found if e.is_dir(follow_symlinks=self.follow))
        except OSError:
            return []
        return [(p, depth + 1, seen | {real}) for p in paths if (real := os.path.realpath(p)) not in seen]

    def partitions(self) -> list[InputPartition]:
        """Breadth first, until there are PARTS folders to walk or none is left; a lopsided tree is dealt out as well."""
        out: list[InputPartition] = []
        left = deque((root, root, 1, frozenset({os.path.realpath(root)})) for root in self.roots)
        while left and len(left) + len(out) < PARTS:
            root, top, depth, seen = left.popleft()
            out.append(_Part(root, top, depth, seen, False))
            left.extend((root, *below) for below in self._below(top, depth, seen))
        return out + [_Part(*part, True) for part in left]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        root = partition.root
        if partition.top == root and partition.depth == 1:
            own = _row(root, root, self.follow)
            if own:
                yield own
        left = [(partition.top, partition.depth, partition.seen)]
        while left:
            folder, depth, seen = left.pop()
            try:
                with os.scandir(folder) as found:
                    names = sorted(e.path for e in found)
            except OSError:
                continue
            for path in names:
                if (row := _row(path, root, self.follow)) is not None:
                    yield row
            if partition.deep:
                left += self._below(folder, depth, seen)


class FileTree(DataSource):
    """``spark.read.format("filetree")``; options roots (a line each), followSymlinks, maxDepth."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema: object) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def read_tree(spark: SparkSession, paths: tuple[str, ...], follow: bool = False, max_depth: int | None = None) -> DataFrame:
    """Folders, files and links below the roots; a path under several roots comes once."""
    check_roots(paths)
    spark.dataSource.register(FileTree)
    options = {"roots": "\n".join(dict.fromkeys(paths)), "followSymlinks": str(follow).lower(), "maxDepth": "" if max_depth is None else str(max_depth)}
    return spark.read.format("filetree").options(**options).load().dropDuplicates(["path"])


def files_of(tree: DataFrame) -> DataFrame:
    """regular files with ``scan_seq``, which rises with the path: the scan order. Write the result before using it twice."""
    files = tree.where("entry_kind = 'file'").select("path", "size", "modified", "created")
    return files.orderBy("path").withColumn("scan_seq", F.monotonically_increasing_id())


def scan_files(spark: SparkSession, options: ScanOptions) -> DataFrame:
    """S1 with F1-F6; without ``recursive`` only the roots' own files."""
    depth = options.max_depth if options.recursive else 1
    return files_of(filter_files(read_tree(spark, options.paths, options.follow_symlinks, depth), options))
