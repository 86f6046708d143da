"""Contents by path (S5-S8): hashes of head and tail, and of whole files in chunks.

Files are dealt by path before they are read, so that one folder's large files don't meet in one task.
An unreadable file has a null hash and is in no group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tallyfold.operators.exact import EDGE, LARGE

CHUNK = 1 << 20


def read_head(path: str, n: int) -> bytes:
    """S5."""
    with open(path, "rb") as f:
        return f.read(n)


def read_tail(path: str, n: int, size: int) -> bytes:
    """S6."""
    with open(path, "rb") as f:
        f.seek(max(size - n, 0))
        return f.read(n)


def partial_digest(path: str, size: int) -> str:
    """X20."""
    h = hashlib.md5(usedforsecurity=False)
    if size < LARGE:
        h.update(read_head(path, LARGE))
    else:
        h.update(f"{size}:".encode() + read_head(path, EDGE) + read_tail(path, EDGE, size))
    return h.hexdigest()


def full_digest(path: str, size: int) -> str:
    """SHA-256, a chunk at a time."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(CHUNK):
            h.update(chunk)
    return h.hexdigest()


def with_digest(files: DataFrame, column: str, digest: Callable[[str, int], str]) -> DataFrame:
    """``files`` with a hash of each path; what ``column`` holds already is not read again."""
    had = column in files.columns
    schema = files.schema if had else files.schema.add(column, "string")

    def one(path: str, size: int) -> str | None:
        try:
            return digest(path, size)
        except OSError:
            return None

    def done(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            old = batch[column] if had else pd.Series([None] * len(batch), dtype=object)
            batch[column] = [o if isinstance(o, str) else one(p, s) for o, p, s in zip(old, batch["path"], batch["size"])]
            yield batch

    return files.repartition("path").mapInPandas(done, schema)


def partial_hashed(files: DataFrame) -> DataFrame:
    return with_digest(files, "partial_hash", partial_digest)


def full_hashed(files: DataFrame) -> DataFrame:
    return with_digest(files, "full_hash", full_digest)
