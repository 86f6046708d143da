"""MinHash near-duplicates: one permutation, optimal densification, banded buckets, star-shaped edges.

One hash per shingle fills all bins of a signature (its high bits choose the bin, the least value in a
bin stays); an empty bin borrows from a bin that a fixed random sequence names, the same for all
documents. ``rows`` bins make a band key; ``bands`` follows from the threshold and the probability
``miss`` that a linked pair shares no band. Documents with equal shingle sets are one class from the
start. In a bucket only edges between the class with the smallest id and each other member are made, so a
bucket of m classes gives m - 1 edges. The components of those candidate edges are clusters.

Links are then confirmed on the full shingle sets. A cluster that fits a block of bounded size is one group
and all its pairs come from one sparse product. In a larger cluster the star edges are confirmed first, each
member with its smallest hub and then with the hubs that it is not yet linked to, a hub with a bounded number
of members a group: a cluster of near copies is settled by as many comparisons as it has members. Only members
that the confirmed edges leave apart are compared with each other and with the cluster's largest part, dealt
by set size (only sizes within the threshold of each other can link) and by hash into blocks, each pair of
blocks one group that emits a spanning forest of its links. No pair that shares a bucket goes unconfirmed unless
both are linked already, no bucket has a cap, and no group of unbounded size meets in one task. Tables that are
joined back to what they were counted from are written first, so that a hot bucket or cluster can be split.

Null and empty texts and texts without words have the empty set and link with nothing; a text of fewer
words than a shingle has its whole word sequence as its one shingle. Very long texts are taken whole.
Repeated rows and ties are equal sets, with the smallest id as component; rows that share an id are one
node; rows without id are kept, with a null component. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.columns import small_batches
from tallyfold.llm.sampling import BROADCAST_IDS, without
from tallyfold.operators.components import FEW_EDGES, connected_components
from tallyfold.plans.storage import write_table

SEED = 1
#: Word hashes a task remembers; classes and shingles in a block at most.
WORDS, BLOCK_ROWS, BLOCK_SHINGLES = 250_000, 256, 500_000
#: Places of members in groups that are broadcast to the sets at most; more are joined by shuffling the sets.
DEALT = 300_000
BORROWS = 100
_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _WordHashes(dict):
    """Hashes of words met before; each task has its own, so that none outlives it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = got = xxhash.xxh3_64_intdigest(word, SEED)
        return got


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int, hashes: _WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles of ``size`` words."""
    words = (text or "").encode("utf-8", "replace").translate(_TO_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), SEED + 1)], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    got = h[:n]
    for k in range(1, size):
        got = _mixed(got + np.uint64(0x9E3779B97F4A7C15)) ^ h[k : k + n]
    return np.unique(_mixed(got))


def bands_for(threshold: float, miss: float) -> tuple[int, int]:
    """(rows, bands): the collision of a band at the threshold is near 0.27, and all miss with ``miss``."""
    rows = max(1, round(math.log(0.27) / math.log(threshold)))
    return rows, math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def _borrow_order(bins: int) -> np.ndarray:
    at = np.arange(bins * BORROWS, dtype=np.uint64).reshape(BORROWS, bins)
    return (_mixed(at + np.uint64(0x51ED270B)) % np.uint64(bins)).astype(np.int64)


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """A row of ``bins`` values for each set, none of them empty."""
    sig = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        at = ((s >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        first = np.flatnonzero(np.diff(at, prepend=np.uint64(bins)))
        where = at[first].astype(np.int64)
        sig[i, where] = s[first]
        full[i, where] = True
    row, bin_ = np.nonzero(~full)
    for donors in _borrow_order(bins):
        if not len(row):
            break
        from_ = donors[bin_]
        ok = full[row, from_]
        sig[row[ok], bin_[ok]] = sig[row[ok], from_[ok]]
        row, bin_ = row[~ok], bin_[~ok]
    for i in np.unique(row):  # nearly empty sets: the next full bin to the right
        at = np.flatnonzero(full[i])
        own = bin_[row == i]
        sig[i, own] = sig[i, at[np.searchsorted(at, own) % len(at)]]
    return sig


def band_keys(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows)
    got = np.broadcast_to(_mixed(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands))
    for k in range(rows):
        got = _mixed(got + parts[:, :, k] + np.uint64(0x9E3779B97F4A7C15))
    return got.view(np.int64) if got.flags["C_CONTIGUOUS"] else np.ascontiguousarray(got).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], size: int, rows: int, bands: int, step: int = 256) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for whole in batches:
        for lo in range(0, whole.num_rows, step):
            batch = whole.slice(lo, step)
            sets = [shingle_set(t, size, hashes) for t in batch.column(1).to_pylist()]
            some = [s for s in sets if len(s)]
            keys = band_keys(signatures(some, rows * bands), rows, bands) if some else np.empty((0, bands), np.int64)
            ends = np.cumsum([0, *(bands if len(s) else 0 for s in sets)])
            name = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), name, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel()))],
                names=["id", "n", "name", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch], size: int, step: int = 256) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for whole in batches:
        for lo in range(0, whole.num_rows, step):
            batch = whole.slice(lo, step)
            sets = [shingle_set(t, size, hashes) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "n", "s"])


def linked_pairs(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with 100 * intersection >= percent * union; within ``a`` (i < j) where b is None."""
    both = a if b is None else [*a, *b]
    sizes = np.array([len(s) for s in both], np.int64)
    owner = np.repeat(np.arange(len(both)), sizes)
    values, inverse, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = times[inverse] > 1
    owner, inverse = owner[shared], inverse[shared]
    column = np.cumsum(times > 1)[inverse] - 1
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    split = len(a) if b is not None else 0
    common = np.zeros((len(a), len(both) - split), np.float32)
    width = 4096
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + width, width))
    for lo, hi in zip(edges[:-1], edges[1:]):
        part = np.zeros((len(both), width), np.float32)
        part[owner[lo:hi], column[lo:hi] % width] = 1
        common += part[: len(a)] @ part[split:].T
    union = sizes[: len(a), None] + sizes[None, split:] - common
    ok = 100 * common.astype(np.float64) >= percent * union.astype(np.float64)
    return np.nonzero(np.triu(ok, 1) if b is None else ok)


def _forest(pairs: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Those of the pairs that join two parts."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x != (p := up.get(x, x)):
            up[x] = x = up.get(p, p)
        return x

    for x, y in pairs:
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            yield x, y


def _confirmed(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (src, dst) of a group's rows (id, s, part, left): among all of them where no ``left`` is null, else between the two sides; never within a part."""
    sets = [np.frombuffer(s, np.uint64) for s in group["s"]]
    ids, part = group["id"].to_numpy(), group["part"].to_numpy()
    if group["left"].isna().any():
        at = bt = np.arange(len(ids))
        i, j = linked_pairs(sets, None, percent)
    else:
        left = group["left"].to_numpy(bool)
        at, bt = np.flatnonzero(left), np.flatnonzero(~left)
        if not len(at) or not len(bt):
            return pd.DataFrame({"src": [], "dst": []}, dtype="int64")
        i, j = linked_pairs([sets[k] for k in at], [sets[k] for k in bt], percent)
    i, j = at[i], bt[j]
    apart = part[i] != part[j]
    found = zip(ids[i[apart]].tolist(), ids[j[apart]].tolist())
    return pd.DataFrame(list(_forest(found)), columns=["src", "dst"]).astype("int64")


def candidate_edges(classes: DataFrame) -> DataFrame:
    """Star edges (src, dst): in each bucket of (id, n, bands) rows, the smallest id with each other.

    A band's number is part of its key. Buckets of two give their edge in the grouped pass; only larger ones have
    their hub joined to their members, by a broadcast behind a count, else between two plain scans.
    """
    buckets = classes.select("id", F.explode("bands").alias("key"))
    hubs = buckets.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count("*").alias("rows")).where("hub < last")
    hubs = write_table(hubs, "hubs")
    large = hubs.where("rows > 2").select("key", "hub")
    few = large.count() <= BROADCAST_IDS
    wide = buckets.join(F.broadcast(large) if few else large, "key").where("id <> hub").select(F.col("hub").alias("src"), F.col("id").alias("dst"))
    return wide.union(hubs.where("rows = 2").select(F.col("hub").alias("src"), F.col("last").alias("dst"))).distinct()


def _blocks(rows: str, total: str, block_rows: int, block_shingles: int) -> Column:
    """Into how many blocks so many rows of so many shingles go."""
    return F.greatest(F.ceil(F.col(rows) / block_rows), F.ceil(F.col(total) / block_shingles)).cast("long")


def star_groups(edges: DataFrame, sizes: DataFrame, block_rows: int, block_shingles: int) -> DataFrame:
    """(pair, id, n, part, left): hubs with their members, at most a block of them in a group; ``sizes`` is (id, n)."""
    sized = write_table(edges.join(sizes.select(F.col("id").alias("dst"), "n"), "dst"), "star_sizes")
    need = sized.groupBy("src").agg(F.count("*").alias("rows"), F.sum("n").alias("total")).select("src", _blocks("rows", "total", block_rows, block_shingles).alias("blocks"))
    dealt = sized.join(write_table(need, "star_blocks"), "src").select("src", "dst", "n", F.pmod(F.xxhash64("dst"), "blocks").alias("block"))
    pair = F.struct("src", "block").alias("pair")
    right = dealt.select(pair, F.col("dst").alias("id"), "n", F.col("dst").alias("part"), F.lit(False).alias("left"))
    hubs = dealt.select("src", "block").distinct().join(sizes.select(F.col("id").alias("src"), "n"), "src")
    return right.union(hubs.select(pair, F.col("src").alias("id"), "n", F.col("src").alias("part"), F.lit(True).alias("left")))


def rest_groups(members: DataFrame, percent: int, block_rows: int, block_shingles: int) -> DataFrame:
    """(pair, id, n, part, left) of members (id, n, cluster, part): each pair of blocks that may hold a link between two parts.

    A cluster's largest part is one side, all its other members are the other; the largest part is not dealt against itself.
    Size levels are powers of 100 / percent, so that only a level and the next can link.
    """
    parts = members.groupBy("cluster", "part").agg(F.count("*").alias("rows"))
    main = parts.groupBy("cluster").agg(F.count("*").alias("parts"), F.max(F.struct("rows", "part")).alias("top")).where("parts > 1")
    main = write_table(main.select("cluster", F.col("top.part").alias("main")), "main_parts")
    step = math.log(100 / percent) * (1 + 1e-9)  # two sizes at the very threshold stay within a level of each other
    level = F.floor(F.log(F.col("n").cast("double")) / step).cast("int")
    sided = write_table(members.join(main, "cluster").select("id", "n", "cluster", "part", level.alias("level"), (F.col("part") != F.col("main")).cast("int").alias("side")), "sided")
    lanes = sided.groupBy("cluster", "level", "side").agg(F.count("*").alias("rows"), F.sum("n").alias("total"))
    lanes = write_table(lanes.select("cluster", "level", "side", _blocks("rows", "total", block_rows, block_shingles).alias("blocks")), "lanes")
    dealt = sided.join(lanes, ["cluster", "level", "side"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    other = lanes.select("cluster", F.col("level").alias("l"), F.col("side").alias("s"), F.col("blocks").alias("other"))
    met = dealt.join(other, "cluster").where("abs(level - l) <= 1 AND side + s > 0").withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other") - 1)))
    x, y = F.struct("level", "side", "block"), F.struct(F.col("l").alias("level"), F.col("s").alias("side"), F.col("o").alias("block"))
    met = met.withColumns({"x": x, "y": y})
    return met.select(F.struct("cluster", F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q")).alias("pair"), "id", "n", "part", F.when(F.col("x") != F.col("y"), F.col("x") < F.col("y")).alias("left"))


def _large_links(members: DataFrame, stars: DataFrame, confirm: Callable[[DataFrame, str], DataFrame], percent: int, block_rows: int, block_shingles: int, few: int) -> DataFrame:
    """Links of the members (id, n, cluster) of clusters beyond a block."""
    edges = write_table(stars.join(members.select(F.col("id").alias("dst")), "dst", "left_semi"), "large_stars")
    first = edges.groupBy("dst").agg(F.min("src").alias("src"))
    links = write_table(confirm(star_groups(first, members, block_rows, block_shingles), "pair"), "star_links")

    def parts() -> DataFrame:
        found = connected_components(links, few=few)
        return write_table(members.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", "n", "cluster", F.coalesce("component", "id").alias("part")), "parts")

    now = parts()
    named = lambda i, p: now.select(F.col("id").alias(i), F.col("part").alias(p))
    open_ = edges.join(named("src", "p"), "src").join(named("dst", "q"), "dst").where("p <> q").select("src", "dst")
    open_ = write_table(open_, "open_stars")
    if not open_.isEmpty():
        links = links.union(write_table(confirm(star_groups(open_, members, block_rows, block_shingles), "pair"), "star_links"))
        now = parts()
    return links.union(confirm(rest_groups(now, percent, block_rows, block_shingles), "pair"))


def near_duplicates(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, miss: float = 1e-8,
    block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES, few: int = FEW_EDGES,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row; ids are whole numbers. Components of ``few`` edges or less are joined in memory."""
    small_batches(documents.sparkSession)
    rows, bands = bands_for(percent / 100, miss)
    texts = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    schema = "id bigint, n bigint, name binary, bands array<bigint>"
    signed = write_table(texts.mapInArrow(lambda it: _signed(it, size, rows, bands), schema), "signed")
    classes = write_table(
        signed.where("name IS NOT NULL AND id IS NOT NULL").groupBy("name").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes"
    )
    stars = write_table(candidate_edges(classes), "stars")
    clusters = connected_components(stars, few=few).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    # An id of several texts is compared by each of its sets.
    members = write_table(classes.select("id", "n").distinct().join(clusters, "id"), "members")
    counts = members.groupBy("cluster").agg(F.count("*").alias("rows"), F.sum("n").alias("total"))
    large = write_table(counts.where(_blocks("rows", "total", block_rows, block_shingles) > 1).select("cluster"), "large")
    # A class's set is made again from the text of its smallest id; few ids are sent to the texts, many are joined.
    sent = members.count() <= BROADCAST_IDS
    ids = members.select("id").distinct()
    chosen = texts.join(F.broadcast(ids) if sent else ids, "id", "left_semi")
    sets = write_table(chosen.mapInArrow(lambda it: _sets(it, size), "id bigint, n bigint, s binary"), "sets")

    def confirm(groups: DataFrame, key: str) -> DataFrame:
        groups = write_table(groups, "groups")
        dealt = F.broadcast(groups) if groups.count() <= DEALT else groups
        return sets.join(dealt, ["id", "n"]).groupBy(key).applyInPandas(lambda g: _confirmed(g, percent), "src bigint, dst bigint")

    whole = members.join(large, "cluster", "left_anti")
    links = confirm(whole.select("cluster", "id", "n", F.monotonically_increasing_id().alias("part"), F.lit(None).cast("boolean").alias("left")), "cluster")
    if not large.isEmpty():
        more = write_table(members.join(large, "cluster", "left_semi"), "large_members")
        links = links.union(_large_links(more, stars, confirm, percent, block_rows, block_shingles, few))
    found = connected_components(links, few=few)
    named = classes.select("name", F.col("id").alias("class")).join(found.withColumnRenamed("node", "class"), "class", "left")
    named = write_table(named.select("name", F.coalesce("component", "class").alias("component")), "named")
    out = signed.select("id", "n", "name").join(named, "name", "left").select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")
    )
    return out.withColumn("kept", F.col(doc_id).eqNullSafe(F.col("component_id")))


def keep_first(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """One document of each component, with the columns of ``documents``; of repeated rows that are kept all stay."""
    return without(documents, near_duplicates(documents, doc_id, text, **options).where("NOT kept"), doc_id)
