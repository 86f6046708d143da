"""Similarity joins (J3-J6) without all-pairs loops.

Names and songs meet through the word join, equal word lists as one, names of large buckets by forms. Hashes: of the bands one must be
within a few bits, so one side lists those neighbours of each band; where that makes too many candidates, blocks of
hashes are compared in whole. Distinct hashes meet, not rows. All are lossless; every candidate is then scored in full, oriented by scan order where the score depends on it.

``*_pairs`` list every pair. ``*_links`` list edges whose components are those of the pairs: what is equal
for the score is one node with an edge to each of its rows, so a million copies give a million edges.
"""

from __future__ import annotations

import logging
import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.bits import HASH_BITS, frame_score, hamming
from tallyfold.functions.paths import base_name, parent_dir
from tallyfold.functions.text import duration_ok, duration_score, words
from tallyfold.operators.member_tiles import member_nodes, size_nodes, spelt_out
from tallyfold.operators.tiles import tiled_pairs
from tallyfold.operators.word_join import BITS, form_scores, list_forms, met_members, pair_scores, scored_lists, word_lists
from tallyfold.plans.storage import write_table

VIDEO_RATIO = 0.6
#: Matched frames that a pair of videos must show before it is scored.
HITS = 3
LOG = logging.getLogger(__name__)


def _named(files: DataFrame, same_dir: bool, max_bucket: int | None, name: Column | None) -> DataFrame:
    """(scan_seq, size, bucket, words) of the files that are compared."""
    rows = files.select(
        "scan_seq", F.col("size"), (parent_dir(F.col("path")) if same_dir else F.lit("")).alias("bucket"), words(base_name(F.col("path")) if name is None else name).alias("words")
    )
    if max_bucket is not None:
        counts = write_table(rows.groupBy("bucket").count(), "folder_counts")
        gone = counts.where(F.col("count") > max_bucket).agg(F.count("*").alias("folders"), F.sum("count").alias("files")).first()
        if gone["folders"]:
            LOG.warning("names of %d files in %d folders of more than %d files are not compared", gone["files"], gone["folders"], max_bucket)
        rows = rows.join(counts.where(F.col("count") <= max_bucket).select("bucket"), "bucket", "left_semi")
    return rows


def name_pairs(files: DataFrame, threshold: int = 80, same_dir: bool = True, max_bucket: int | None = None, name: Column | None = None) -> DataFrame:
    """(src, dst, score) with size ratio and word score at least threshold / 100.

    ``max_bucket`` (3000 for parity) leaves out folders (or, over all folders, the whole) with more files and logs them; None has no such limit.
    """
    return _name_tiles(files, threshold, same_dir, max_bucket, name, False)


def _name_tiles(files: DataFrame, threshold: int, same_dir: bool, max_bucket: int | None, name: Column | None, forest: bool) -> DataFrame:
    """(src, dst, score) of all pairs of names, or of spanning forests of them."""
    lists, members = word_lists(_named(files, same_dir, max_bucket, name))
    least = threshold / 100.0
    # The copies of a list meet by themselves, and so do lists that are scored one by one; of copies with one size a forest needs one.
    copied = members.groupBy("id").count().where(F.lit(not forest) & (F.col("count") > 1)).select(F.col("id").alias("x"), F.col("id").alias("y"), F.lit(1.0).alias("score"))
    own = None
    if forest:
        members, own = size_nodes(members)
        own = own.select("src", "dst", F.lit(1.0).alias("score"))
    formed = list_forms(lists, least)
    if formed is None:
        one = scored_lists(lists, least).where("x <> y")
        met = spelt_out(member_nodes(members, "id"), write_table(one.where(F.col("score") >= least).union(copied), "list_links"), forest=forest)
        return met.union(own) if forest else met
    forms, of_list, contacts = formed
    one = write_table(pair_scores(lists, contacts, least).where(F.col("score") >= least).union(copied), "list_links")
    met = one.select(F.col("x").alias("id")).union(one.select("y")).distinct()
    alone = spelt_out(member_nodes(members.join(met, "id", "left_semi"), "id"), one, forest=forest)
    placed = write_table(members.join(of_list, "id"), "form_members")
    scored = write_table(form_scores(forms, least).where(F.col("score") >= least), "form_links")
    used = scored.select(F.col("x").alias("form")).union(scored.select(F.col("y"))).distinct()
    nodes = member_nodes(placed.join(used, "form", "left_semi"), "form")
    where = nodes.select(F.col("node").alias("form"), "chunk", F.explode(F.array_distinct("ids")).alias("id"))
    side = lambda i, f, c: where.select(F.col("id").alias(i), F.col("form").alias(f), F.col("chunk").alias(c))
    both = contacts.select(F.col("x").alias("bx"), F.col("y").alias("by")).union(contacts.select("y", "x"))
    both = both.join(side("bx", "x", "l_chunk"), "bx").join(side("by", "y", "r_chunk"), "by").join(scored.select("x", "y"), ["x", "y"], "left_semi")
    banned = both.groupBy("x", "l_chunk", "y", "r_chunk").agg(F.sort_array(F.collect_list(F.struct("bx", "by"))).alias("b"))
    banned = write_table(banned.select("x", "l_chunk", "y", "r_chunk", F.col("b.bx").alias("bx"), F.col("b.by").alias("by")), "contact_tiles")
    alike = alone.union(spelt_out(nodes, scored, apart=True, banned=banned, forest=forest))
    return alike.union(own) if forest else alike


def name_links(files: DataFrame, threshold: int = 80, same_dir: bool = True, max_bucket: int | None = None, name: Column | None = None) -> DataFrame:
    """Edges (src, dst) with the components of ``name_pairs``: copies are star edges, and where arrays of others meet, their forest is an edge a member."""
    return _name_tiles(files, threshold, same_dir, max_bucket, name, True).select("src", "dst")


def _songs(tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    line = F.concat(F.coalesce("artist", F.lit("")), F.lit(" "), F.coalesce("title", F.lit("")))
    return word_lists(tags.select("scan_seq", F.coalesce(F.col("duration"), F.lit(0)).cast("bigint").alias("duration"), F.lit("").alias("bucket"), words(line).alias("words")))


def _least_words(threshold: int) -> float:
    """The word score that a song pair needs; the duration gives a tenth at most, so the lowest thresholds need hardly any."""
    return max((threshold / 100.0 - 0.1) / 0.9, 1e-6)


def _alike_in_time(songs: DataFrame) -> DataFrame:
    """(src, dst) of songs whose durations alone score."""
    band = F.length(F.bin("duration"))  # a larger one is twice a smaller one at most
    some = songs.where("duration > 0").select("scan_seq", "duration", band.alias("band"))
    left = some.select(F.col("scan_seq").alias("src"), F.col("duration").alias("a"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    right = some.select(F.col("scan_seq").alias("dst"), F.col("duration").alias("b"), "band")
    return left.join(right, "band").where((F.col("src") < F.col("dst")) & duration_ok(F.col("a"), F.col("b")) & (duration_score(F.col("a"), F.col("b")) > 0))


def music_pairs(tags: DataFrame, threshold: int = 80) -> DataFrame:
    """(src, dst, score) of 0.9 * word score + 0.1 * duration score, for durations that fit.

    Up to a threshold of 10 a fitting duration is enough, so pairs without a common word are found by
    duration; songs without words score nothing by words.
    """
    if threshold <= 10:
        tags = write_table(tags, "songs")
    lists, members = _songs(tags)
    full = lambda score, a, b: 0.9 * score + 0.1 * duration_score(a, b)
    keep = lambda score, a, b: duration_ok(a["duration"], b["duration"]) & (full(score, a["duration"], b["duration"]) >= threshold / 100.0)
    met = met_members(members, scored_lists(lists, _least_words(threshold)), "duration", keep=keep)
    got = met.select("src", "dst", full(F.col("score"), F.col("l_duration"), F.col("r_duration")).alias("score"))
    if threshold <= 10:
        songs = tags.select("scan_seq", F.coalesce(F.col("duration"), F.lit(0)).cast("bigint").alias("duration"))
        more = _alike_in_time(songs).select("src", "dst", (0.1 * duration_score(F.col("a"), F.col("b"))).alias("score"))
        got = got.union(more).groupBy("src", "dst").agg(F.max("score").alias("score"))
    return got.where(F.col("score") >= threshold / 100.0)


def music_links(tags: DataFrame, threshold: int = 80) -> DataFrame:
    """C4: edges (src, dst) with the components of ``music_pairs``: songs of equal words and duration are a node."""
    if threshold <= 10:
        return music_pairs(tags, threshold).select("src", "dst")
    level = threshold / 100.0
    lists, members = _songs(tags)
    # A node's songs link with each other unless the duration is unknown and the words alone don't do.
    alone = F.when((F.col("duration") == 0) & F.lit(0.9 < level), F.col("scan_seq")).otherwise(-1)
    rows = members.withColumn("alone", alone)
    nodes = write_table(rows.groupBy("id", "duration", "alone").agg(F.min("scan_seq").alias("lo"), F.max("scan_seq").alias("hi")), "song_nodes")
    stars = rows.join(nodes, ["id", "duration", "alone"]).where("scan_seq <> lo").select(F.col("lo").alias("src"), F.col("scan_seq").alias("dst"))
    ds = lambda a, b: duration_ok(a, b) & (0.9 + 0.1 * duration_score(a, b) >= level)
    # Within a list the next duration decides, as all that lie further apart fit less; an unknown one fits all or none.
    timed = nodes.where("duration > 0")
    after = Window.partitionBy("id").orderBy("duration")
    steps = timed.withColumns({"next": F.lead("lo").over(after), "then": F.lead("duration").over(after)}).where(F.col("next").isNotNull() & ds(F.col("duration"), F.col("then"))).select(F.col("lo").alias("src"), F.col("next").alias("dst"))
    if 0.9 >= level:
        void = nodes.where("duration = 0").select("id", F.col("lo").alias("src"))
        steps = steps.union(void.join(timed.select("id", F.col("lo").alias("dst")), "id").select("src", "dst"))
    side = lambda p: nodes.select(*(F.col(c).alias(p + c) for c in ("id", "duration", "lo", "hi")))
    scored = scored_lists(lists, _least_words(threshold)).where("x <> y")
    met = scored.join(side("a_"), F.col("a_id") == F.col("x")).join(side("b_"), F.col("b_id") == F.col("y"))
    a, b = F.col("a_duration"), F.col("b_duration")
    cross = met.where((F.col("a_lo") < F.col("b_hi")) & duration_ok(a, b) & (0.9 * F.col("score") + 0.1 * duration_score(a, b) >= level)).select(F.col("a_lo").alias("src"), F.col("b_lo").alias("dst"))
    return stars.union(steps).union(cross)


#: Neighbours that one hash may list at most, and hashes compared in a block in the time of one joined row.
PROBES, COMPARED = 100_000, 50


def _cuts(n: int) -> list[tuple[int, int]]:
    """(shift, width) of n bands."""
    edges = [round(HASH_BITS * k / n) for k in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _bands(radius: int, rows: int) -> list[tuple[int, int]] | None:
    """The bands with the least work for ``rows`` hashes: neighbours listed, and candidates if bits were random; None if comparing all is less."""

    def work(n: int) -> float:
        slack = radius // n
        near = [sum(math.comb(w, k) for k in range(min(slack, w) + 1)) for _, w in _cuts(n)]
        if sum(near) > PROBES:
            return math.inf
        return rows * (sum(near) + n) + rows * rows / 2 * min(1.0, sum(v / 2**w for v, (_, w) in zip(near, _cuts(n))))

    best = min(range(1, HASH_BITS + 1), key=work)
    return None if rows * rows / 2 / COMPARED <= work(best) else _cuts(best)


def _band(hash_: Column, shift: int, width: int) -> Column:
    return F.shiftright(hash_, shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def _distinct_pairs(hashes: DataFrame, radius: int, forest: bool = False) -> DataFrame:
    """(p, q, distance) of the distinct values ``phash``, each pair once, p before q; with ``forest``, as many as make the same components."""
    radius = min(radius, 64)
    rows = hashes.count()
    bands = _bands(radius, rows)
    if bands is None:
        return tiled_pairs(hashes, radius, rows, forest)
    slack = radius // len(bands)
    masks = [[sum(1 << b for b in bits) for k in range(min(slack, w) + 1) for bits in combinations(range(w), k)] for _, w in bands]
    spark = hashes.sparkSession
    # At most PROBES rows; a band's neighbours differ from it by these bits.
    flips = spark.createDataFrame([(i, m) for i, own in enumerate(masks) for m in own], "band int, flip bigint")
    own = F.array(*(F.struct(F.lit(i).alias("band"), _band(F.col("phash"), *b).alias("bits")) for i, b in enumerate(bands)))
    banded = hashes.select("phash", F.inline(own))
    left = banded.join(F.broadcast(flips), "band").select(F.col("phash").alias("p"), "band", F.col("bits").bitwiseXOR(F.col("flip")).alias("bits"))
    right = banded.withColumnRenamed("phash", "q")
    # A pair is kept in the first of the bands that it is near in.
    first = F.lit(None).cast("int")
    for i in reversed(range(len(bands))):
        first = F.when(hamming(_band(F.col("p"), *bands[i]), _band(F.col("q"), *bands[i])) <= slack, i).otherwise(first)
    met = left.join(right, ["band", "bits"]).where((F.col("p") < F.col("q")) & (hamming(F.col("p"), F.col("q")) <= radius) & (first == F.col("band")))
    return met.select("p", "q", hamming(F.col("p"), F.col("q")).alias("distance"))


def _hash_classes(hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a hash, distinct hashes with their least row lo), both written."""
    rows = write_table(hashes.where("phash IS NOT NULL").select("scan_seq", "phash"), "hashes")
    return rows, write_table(rows.groupBy("phash").agg(F.min("scan_seq").alias("lo")), "hash_classes")


def hash_pairs(hashes: DataFrame, radius: int) -> DataFrame:
    """(src, dst, distance) of rows (scan_seq, phash), each pair once, src before dst."""
    rows, classes = _hash_classes(hashes)
    near = write_table(_distinct_pairs(classes.select("phash"), radius), "near_hashes")
    same = classes.select(F.col("phash").alias("p"), F.col("phash").alias("q"), F.lit(0).alias("distance"))
    both = near.union(near.select("q", "p", "distance")).union(same)
    left, right = rows.select(F.col("scan_seq").alias("src"), F.col("phash").alias("p")), rows.select(F.col("scan_seq").alias("dst"), F.col("phash").alias("q"))
    return left.join(both, "p").join(right, "q").where("src < dst").select("src", "dst", "distance")


def hash_links(hashes: DataFrame, radius: int) -> DataFrame:
    """Edges (src, dst) with the components of ``hash_pairs``: equal hashes are one node."""
    rows, classes = _hash_classes(hashes)
    stars = rows.join(classes, "phash").where("scan_seq <> lo").select(F.col("lo").alias("src"), F.col("scan_seq").alias("dst"))
    near = _distinct_pairs(classes.select("phash"), radius, True)
    named = lambda h, n: classes.select(F.col("phash").alias(h), F.col("lo").alias(n))
    return stars.union(near.join(named("p", "src"), "p").join(named("q", "dst"), "q").select("src", "dst"))


def _video_classes(signatures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(videos with frames, distinct signatures with an id and their least video lo), both written."""
    rows = write_table(signatures.where("size(sig) > 0").select("scan_seq", "sig"), "videos")
    classes = rows.groupBy("sig").agg(F.min("scan_seq").alias("lo"))
    return rows, write_table(classes.withColumn("id", F.monotonically_increasing_id()), "video_classes")


def _near_signatures(classes: DataFrame, radius: int, ratio: float) -> DataFrame:
    """(a, b, score) of ids of different signatures, each pair once, with a frame score of ``ratio`` or more.

    In one of the two directions at least ``ratio`` of the frames are matched, so from that side ``k`` of the
    first n - ceil(ratio * n) + k frames are, in any order: those come first that the fewest videos show.
    """
    shown = write_table(classes.select("id", F.size("sig").alias("n"), F.posexplode("sig").alias("at", "phash")), "frames")
    frames = write_table(shown.groupBy("phash").agg(F.countDistinct("id").alias("videos")), "distinct_frames")
    near = write_table(_distinct_pairs(frames.select("phash"), radius).select("p", "q"), "near_frames")
    both = near.union(near.select("q", "p")).union(frames.select(F.col("phash").alias("p"), F.col("phash").alias("q")))
    cost = write_table(both.join(frames, F.col("q") == F.col("phash")).groupBy(F.col("p").alias("phash")).agg(F.sum("videos").alias("cost")), "frame_costs")
    ordered = shown.join(cost, "phash").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("cost", "at", "phash"))).alias("f"))
    need = F.ceil(F.col("n") * F.lit(ratio) - 1e-9).cast("int")
    ordered = ordered.withColumn("k", F.greatest(F.lit(1), F.least(F.lit(HITS), need)))
    prefix = F.col("n") - need + F.col("k")
    probes = write_table(ordered.select(F.col("id").alias("x"), "k", F.posexplode(F.slice("f", F.lit(1), prefix)).alias("pos", "f")).select("x", "k", "pos", F.col("f.phash").alias("p")), "frame_probes")
    other = shown.select(F.col("id").alias("y"), F.col("phash").alias("q")).distinct()
    # A frame's place in the prefix is a bit; those from BITS on share the last, which is taken for enough.
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(F.col("pos"), F.lit(BITS)))
    hits = probes.join(both, "p").join(other, "q").where("x <> y").groupBy("x", "y").agg(F.bit_or(bit).alias("hit"), F.first("k").alias("k"))
    hits = hits.where((F.bit_count("hit") >= F.col("k")) | (F.col("hit") >= F.lit(1 << BITS)))
    pairs = write_table(hits.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "video_candidates")
    sig = lambda i, s: classes.select(F.col("id").alias(i), F.col("sig").alias(s))
    scored = pairs.join(sig("a", "x"), "a").join(sig("b", "y"), "b").select("a", "b", frame_score(F.col("x"), F.col("y"), radius).alias("score"))
    return write_table(scored, "video_scores").where(F.col("score") >= ratio)


def video_pairs(signatures: DataFrame, radius: int, ratio: float = VIDEO_RATIO) -> DataFrame:
    """(src, dst, score) of rows (scan_seq, sig) with a frame score of ``ratio`` or more."""
    rows, classes = _video_classes(signatures)
    near = _near_signatures(classes, radius, ratio)
    both = near.union(near.select("b", "a", "score")).union(classes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score")))
    named = write_table(rows.join(classes.select("sig", "id"), "sig").select("scan_seq", "id"), "video_ids")
    left, right = named.select(F.col("scan_seq").alias("src"), F.col("id").alias("a")), named.select(F.col("scan_seq").alias("dst"), F.col("id").alias("b"))
    return left.join(both, "a").join(right, "b").where("src < dst").select("src", "dst", "score")


def video_links(signatures: DataFrame, radius: int, ratio: float = VIDEO_RATIO) -> DataFrame:
    """Edges (src, dst) with the components of ``video_pairs``: equal signatures are one node."""
    rows, classes = _video_classes(signatures)
    stars = rows.join(classes.select("sig", "lo"), "sig").where("scan_seq <> lo").select(F.col("lo").alias("src"), F.col("scan_seq").alias("dst"))
    named = lambda i, n: classes.select(F.col("id").alias(i), F.col("lo").alias(n))
    return stars.union(_near_signatures(classes, radius, ratio).join(named("a", "src"), "a").join(named("b", "dst"), "b").select("src", "dst"))
