"""Pairs of the members of nodes that score, spelt out array against array.

A node's members are short arrays, as many as it needs. Where two arrays meet, a task compares them with numpy and
writes out every pair, or, where only components are asked for, a spanning forest of the pairs, so that a million
alike members give a million edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.plans.storage import write_table

#: Members of a node in one array, about; cells of two arrays that are compared at once; and pairs in a batch, about.
CHUNK, CELLS, PAIRS = 1024, 1 << 18, 1 << 16


def member_nodes(members: DataFrame, node: str) -> DataFrame:
    """(node, chunk, seqs, ids, sizes, lo, hi), written, of members (scan_seq, id, size and ``node``); those without a size pair with nothing.

    Members with a ``hi`` stand for rows from scan_seq to ``hi``, which are kept as ``his``.
    """
    several = ["hi"] if "hi" in members.columns else []
    members = members.where("size IS NOT NULL").select(F.col(node).alias("node"), "scan_seq", "id", "size", *several)
    sized = members.groupBy("node").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = members.join(write_table(sized, "node_sizes"), "node").withColumn("chunk", F.pmod(F.xxhash64("scan_seq"), F.col("chunks")))
    row = F.sort_array(F.collect_list(F.struct("scan_seq", "id", "size", *several)))
    nodes = dealt.groupBy("node", "chunk").agg(row.alias("r"), F.min("scan_seq").alias("lo"), F.max(several[0] if several else "scan_seq").alias("hi"))
    return write_table(nodes.select("node", "chunk", F.col("r.scan_seq").alias("seqs"), F.col("r.id").alias("ids"), F.col("r.size").alias("sizes"), *(F.col("r.hi").alias("his") for _ in several), "lo", "hi"), "node_members")


def size_nodes(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of members (scan_seq, id, size): members of an id that are equal in size are a node, and edges make an id's components.

    A node is its least ``scan_seq`` with the greatest as ``hi``. Between nodes the next size decides, as all further ones fit less.
    """
    members = members.where("size IS NOT NULL")
    nodes = write_table(members.groupBy("id", "size").agg(F.min("scan_seq").alias("scan_seq"), F.max("scan_seq").alias("hi")), "size_nodes")
    first = nodes.where("scan_seq < hi").select("id", "size", F.col("scan_seq").alias("src"))
    stars = members.join(first, ["id", "size"]).where("scan_seq <> src").select("src", F.col("scan_seq").alias("dst"))
    after = Window.partitionBy("id").orderBy("size")
    steps = nodes.select(F.col("scan_seq").alias("src"), "size", F.lead("scan_seq").over(after).alias("dst"), F.lead("size").over(after).alias("then"))
    return nodes, stars.union(steps.where("then <= 4 * size").select(F.least("src", "dst"), F.greatest("src", "dst")))


def _linked(seqs: tuple, ids: tuple, sizes: tuple, apart: bool, banned: tuple | None, at: slice) -> np.ndarray:
    """Which of the left array's members ``at`` pair with which of the right one's."""
    now = seqs[0][at, None] < seqs[1][None]
    now &= sizes[0][at, None] <= 4 * sizes[1][None]
    now &= sizes[1][None] <= 4 * sizes[0][at, None]
    if apart:
        now &= ids[0][at, None] != ids[1][None]
    if banned is not None:
        now &= ~banned[0][banned[1][at]][:, banned[2]]
    return now


def _after(seqs: tuple, at: slice) -> tuple[np.ndarray, np.ndarray]:
    """(src, dst) of all that the order alone decides; arrays are sorted."""
    left, right = seqs[0][at], seqs[1]
    start = np.searchsorted(right, left, "right")
    return np.repeat(left, len(right) - start), np.concatenate([right[s:] for s in start.tolist()])


def _ban(ids: tuple, x: np.ndarray, y: np.ndarray) -> tuple:
    """A table of the pairs of different ids that are left out, and the place in it of each member."""
    (u, i), (v, j) = (np.unique(side, return_inverse=True) for side in ids)
    table = np.zeros((len(u), len(v)), bool)
    table[np.searchsorted(u, x), np.searchsorted(v, y)] = True
    return table, i, j


def _forest(now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a spanning forest of the bipartite graph ``now``."""
    left, right = np.flatnonzero(now.any(1)), np.flatnonzero(now.any(0))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front):
            part = now[np.ix_(front, right)]
            met = part.any(0)
            got = right[met]
            out.append((front[part.argmax(0)[met]], got))
            right = right[~met]
            part = now[np.ix_(left, got)]
            met = part.any(1) if len(got) else np.zeros(len(left), bool)
            front = left[met]
            if len(front):
                out.append((front, got[part[met].argmax(1)]))
            left = left[~met]
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, int), np.empty(0, int))


def _spell(forest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        batch_of = lambda: pa.record_batch([np.concatenate(c) for c in zip(*found)], names=["src", "dst", "score"])
        for batch in batches:
            array = lambda name, k: batch.column(name)[k].values.to_numpy()  # noqa: B023, E731
            scores, aparts, bans = batch.column("score").to_numpy(), batch.column("apart").to_pylist(), batch.column("bx").is_valid().to_pylist()
            for k, (score, apart, ban) in enumerate(zip(scores, aparts, bans)):
                seqs, ids, sizes = ((array(f"l_{c}", k), array(f"r_{c}", k)) for c in ("seqs", "ids", "sizes"))
                banned = _ban(ids, array("bx", k), array("by", k)) if ban else None
                fit = sizes[0].max() <= 4 * sizes[1].min() and sizes[1].max() <= 4 * sizes[0].min()
                whole = fit and not forest and not apart and banned is None
                order = (seqs[0], array("r_his", k)) if forest else seqs
                rows = len(seqs[0]) if forest else max(CELLS // len(seqs[1]), 1)
                for at in range(0, len(seqs[0]), rows):
                    if whole:
                        src, dst = _after(seqs, slice(at, at + rows))
                    else:
                        now = _linked(order, ids, sizes, apart, banned, slice(at, at + rows))
                        i, j = _forest(now) if forest else np.divmod(np.flatnonzero(now), now.shape[1])
                        src, dst = order[0][at + i], order[1][j]
                    if not len(src):
                        continue
                    found.append((src, dst, np.full(len(src), score)))
                    held += len(src)
                    if held >= PAIRS:
                        yield batch_of()
                        found, held = [], 0
        if found:
            yield batch_of()

    return run


def spelt_out(nodes: DataFrame, scored: DataFrame, apart: bool = False, banned: DataFrame | None = None, forest: bool = False) -> DataFrame:
    """(src, dst, score) for members of nodes x and y of ``scored`` (x, y, score), src before dst, whose sizes are within a factor of four.

    ``apart`` leaves out members of one id; ``banned`` (x, l_chunk, y, r_chunk, bx, by) has the ids that are left out where two
    arrays meet. With ``forest`` nodes are of members with a ``hi``, and the pairs are a spanning forest of those of each two arrays,
    from a node's first row to the other's last.
    """
    side = lambda p, i: nodes.select(F.col("node").alias(i), *(F.col(c).alias(p + c) for c in nodes.columns if c != "node"))
    met = side("l_", "x").join(scored, "x").join(side("r_", "y"), "y").where("l_lo < r_hi")
    none = F.lit(None).cast("array<bigint>")
    met = met.withColumns({"bx": none, "by": none}) if banned is None else met.join(banned, ["x", "l_chunk", "y", "r_chunk"], "left")
    # Few and short rows become many: they are dealt out by number and not by bytes.
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = met.select("score", F.lit(apart).alias("apart"), "l_seqs", "l_ids", "l_sizes", "r_seqs", "r_ids", "r_sizes", *(["r_his"] if forest else []), "bx", "by").repartition(4 * parts)
    return tiles.mapInArrow(_spell(forest), "src bigint, dst bigint, score double")
