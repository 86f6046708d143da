"""Connected components over an edge table (G1): alternating large-star and small-star steps.

Each step is a grouped minimum joined back to the edges, so no neighbourhood is ever gathered into one
row or one task. The minima, a row a node, are written before the join: a small table is then broadcast
by its size, and beyond that both sides of the join are plain scans, which adaptive execution splits
where a hub has many of the edges. The edge set is written to the shared folder after each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.plans.storage import drop_table, write_table

#: Edges that are joined at once in memory; and those that callers let one task finish (64 MB of ids).
STRIP, FEW_EDGES = 1 << 16, 4_000_000


def lowest_joined(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Edges (a, b) with the least neighbour m of a, from a written table (a, m)."""
    return edges.join(low, "a")


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The step's edges and the table of minima that they read."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = write_table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "low")
    return lowest_joined(both.where("b > a"), low).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), low


def _small_star(down: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``_large_star``, for edges whose a is the greater end."""
    low = write_table(down.groupBy("a").agg(F.min("b").alias("m")), "low")
    moved = lowest_joined(down, low).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), low


def _settled(edges: DataFrame) -> bool:
    """Whether every a names one b and no b is an a, so that both steps would change nothing."""
    ends = edges.select("a", F.lit(1).alias("n"), F.lit(False).alias("low")).union(edges.select(F.col("b").alias("a"), F.lit(0).alias("n"), F.lit(True).alias("low")))
    return ends.groupBy("a").agg(F.sum("n").alias("n"), F.max("low").alias("low")).where("n > 1 OR (n > 0 AND low)").isEmpty()


class Trees:
    """The trees that edges between places 0 to n - 1 have made so far; the top of a tree is its least place."""

    def __init__(self, n: int) -> None:
        self.top = np.arange(n)

    def joining(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the edges (i, j), in their order, join two trees."""
        a, b = self.top[i], self.top[j]
        apart = np.flatnonzero(a != b)
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while x in up:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        out = []
        for k, x, y in zip(apart.tolist(), a[apart].tolist(), b[apart].tolist()):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append(k)
        if out:
            moved = np.arange(len(self.top))
            for x in list(up):
                moved[x] = find(x)
            self.top = moved[self.top]
        return np.array(out, np.int64)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (a, b) that come."""
    ends = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
    if not ends:
        return
    a, b = (np.concatenate(c) for c in zip(*ends))
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    trees, i, j = Trees(len(nodes)), place[: len(a)], place[len(a) :]
    for at in range(0, len(i), STRIP):
        trees.joining(i[at : at + STRIP], j[at : at + STRIP])
    for at in range(0, len(nodes), STRIP):
        yield pa.record_batch([nodes[at : at + STRIP], nodes[trees.top[at : at + STRIP]]], names=["node", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, few: int = 0) -> DataFrame:
    """Columns (node, component): the smallest node reachable, for every node with an edge to another.

    Nulls and self-loops name no edge and are ignored; repeated edges change nothing; an empty edge
    table gives an empty result. Nodes without edges are not listed: they are their own component.
    Once ``few`` edges or less are there, at the start as they come or behind a round, one task finishes them in memory.
    """

    def finished(some: DataFrame) -> DataFrame | None:
        if not few or some.count() > few:
            return None
        done = write_table(some.coalesce(1).mapInArrow(_stars, "node bigint, component bigint"), "cc")
        drop_table(some)
        return done

    whole = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    if few:
        whole = write_table(whole, "cc_edges")
        if (done := finished(whole)) is not None:
            return done
    now = write_table(whole.distinct(), "cc")
    if few:
        drop_table(whole)
    for _ in range(max_rounds):
        if (done := finished(now)) is not None:
            return done
        if _settled(now):
            break
        large, low = _large_star(now)
        wide = write_table(large, "cc")
        small, below = _small_star(wide)
        after = write_table(small, "cc")
        for done in (now, low, wide, below):
            drop_table(done)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
