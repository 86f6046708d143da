"""All pairs of a set of distinct hashes, block against block.

At a wide radius a good part of all pairs shares a band, and to join those rows costs far more than to compare
every pair in memory. A hash falls into a block by its own hash, so blocks are even; each pair of blocks is a
tile of one or two short rows, dealt out by number, and a task compares the hashes of its tiles with numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.components import Trees

#: Hashes of a block, about; and how many are compared with a block at once.
BLOCK, ROWS = 8192, 16


def _batch(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.record_batch([np.concatenate(c) for c in zip(*found)], names=["p", "q", "distance"])


def _near(a: np.ndarray, b: np.ndarray | None, radius: int, forest: bool) -> Iterator[pa.RecordBatch]:
    """(p, q, distance) of the pairs between two blocks, or within one, or of a spanning forest of them."""
    other = a if b is None else b
    trees, start = Trees(len(a) + (0 if b is None else len(b))), 0 if b is None else len(a)
    bits, far = np.empty((ROWS, len(other)), np.int64), np.empty((ROWS, len(other)), np.uint8)
    found = []
    for at in range(0, len(a), ROWS):
        some = a[at : at + ROWS]
        now = np.bitwise_count(np.bitwise_xor(some[:, None], other[None], out=bits[: len(some)]), out=far[: len(some)])
        i, j = np.divmod(np.flatnonzero(now <= radius), len(other))
        if b is None:
            i, j = i[at + i < j], j[at + i < j]
        if forest and len(i):
            new = trees.joining(at + i, start + j)
            i, j = i[new], j[new]
        if len(i):
            x, y = some[i], other[j]
            found.append((np.minimum(x, y), np.maximum(x, y), now[i, j].astype(np.int32)))
        if len(found) >= ROWS:
            yield _batch(found)
            found = []
    if found:
        yield _batch(found)


def _compare(radius: int, forest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, first = None, None
        for batch in batches:
            hashes = batch.column("hashes")
            for k, (now, single) in enumerate(zip(batch.column("tile").to_pylist(), batch.column("single").to_pylist())):
                block = hashes[k].values.to_numpy()
                if single:
                    yield from _near(block, None, radius, forest)
                elif tile == now:
                    yield from _near(first, block, radius, forest)
                else:
                    tile, first = now, block

    return run


def tiled_pairs(hashes: DataFrame, radius: int, rows: int, forest: bool = False) -> DataFrame:
    """(p, q, distance), p before q, of the pairs of distinct values ``phash``, ``rows`` of them, within ``radius``; with ``forest``, of a spanning forest of those of each tile."""
    parts = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(math.ceil(rows / BLOCK), min(math.ceil(math.sqrt(8 * parts)), math.ceil(rows / 256)), 1)
    blocks = hashes.groupBy(F.pmod(F.xxhash64("phash"), F.lit(n)).alias("block")).agg(F.collect_list("phash").alias("hashes"))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    tiles = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select((i * n + j).alias("tile"), (F.col("block") == F.col("other")).alias("single"), "hashes")
    dealt = tiles.repartition(parts, "tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(_compare(min(radius, 64), forest), "p bigint, q bigint, distance int")
