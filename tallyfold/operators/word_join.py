"""The word join behind names and songs (J3, J5): pairs of word lists whose score can reach a threshold.

Equal lists are one row. Of a pair, the shorter list (of equals the one with the smaller id) probes: at a
score of ``least`` at least ``least`` times its words must be matched, so one of its first
``m - ceil(least * m) + 1`` words is, whatever order they are put in. The order is by what a word costs,
the number of list words that share a deletion variant with it, so a word that stands in every list is
probed last and mostly not at all. Words that no probe can meet leave the other side before the join.
What is joined are ids and positions; the words come back to the pairs that remain, and each pair is
scored once, behind a written table, so that no optimizer moves the score into the join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.text import matched_words, variants
from tallyfold.plans.storage import write_table

#: Positions of a probe that have a bit of their own; further ones share the last.
BITS = 62
#: Members of a node in one array, about.
CHUNK = 1024
#: A bucket with more lists is joined by forms, in which words are left out that so many words share a variant with at most.
WIDE, RARE = 4096, 512


def word_lists(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lists, members) of rows (scan_seq, bucket, words, ...): lists (id, bucket, words, lo, hi) are distinct; members are the rows with words, with their list's id.

    ``lo`` and ``hi`` are the least and greatest ``scan_seq`` of a list.
    """
    rows = write_table(rows.where(F.size("words") > 0), "word_rows")
    lists = rows.groupBy("bucket", "words").agg(F.min("scan_seq").alias("lo"), F.max("scan_seq").alias("hi"))
    lists = write_table(lists.withColumn("id", F.monotonically_increasing_id()), "word_lists")
    return lists, write_table(rows.join(lists.select("bucket", "words", "id"), ["bucket", "words"]).drop("bucket", "words"), "members")


def _word_costs(lists: DataFrame, similar: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words of the lists, their keys, their costs), all written; the empty word is none."""
    words = write_table(lists.select("id", "bucket", F.size("words").alias("m"), F.posexplode("words").alias("at", "word")).where("word <> ''"), "list_words")
    shown = write_table(words.groupBy("bucket", "word").agg(F.count("*").alias("n")).withColumn("key", F.explode((variants if similar else F.array)(F.col("word")))), "word_keys")
    of_key = write_table(shown.groupBy("bucket", "key").agg(F.sum("n").alias("n")), "key_counts")
    return words, shown, write_table(shown.drop("n").join(of_key, ["bucket", "key"]).groupBy("bucket", "word").agg(F.sum("n").alias("cost")), "word_costs")


def _one_edit(word: str, other: str) -> Column:
    return (F.col(word) == F.col(other)) | (F.levenshtein(word, other, 1).between(0, 1) & (F.least(F.length(word), F.length(other)) >= 2))


def _edit_keys(probe: bool) -> Column:
    """Keys of ``word``, which a probe and a word share once if they are one edit apart and both have two characters or more; no others share one."""
    word, n = F.col("word"), F.length("word")
    without = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    own, cut = ("w", "d") if probe else ("d", "w")
    changed = F.transform(without, lambda w, i: F.concat(i.cast("string"), F.lit("s"), w))
    shorter = F.when(n >= 3, F.transform(F.array_distinct(without), lambda w: F.concat(F.lit(cut), w))).otherwise(F.array().cast("array<string>"))
    return F.when(n >= 2, F.concat(changed, F.array(F.concat(F.lit(own), word)), shorter)).otherwise(F.array().cast("array<string>"))


def rare_neighbours(cost: DataFrame) -> DataFrame:
    """(bucket, word, other) of rare words and what they match, of (bucket, word, cost); of two rare words one order is enough."""
    rare = F.col("cost") <= RARE
    left = cost.where(rare).select("bucket", "word", F.explode(_edit_keys(True)).alias("key"))
    right = cost.select("bucket", F.col("word").alias("other"), rare.alias("both"), F.explode(_edit_keys(False)).alias("key"))
    near = left.join(right, ["bucket", "key"]).where("NOT both OR word < other").select("bucket", "word", "other")
    return near.union(cost.where(rare).select("bucket", "word", F.col("word").alias("other")))


def list_forms(lists: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(forms, of_list, contacts), written, or None where every bucket is small.

    In a bucket of more than ``WIDE`` lists a word that few words there can match is rare, and a form is a list with empty words
    for its rare ones. Forms are lists; ``of_list`` (id, form) has the form of each list. ``contacts`` (x, y) are the pairs of lists of which
    a rare word of one is near a word of the other, each pair once, if their lengths allow ``least``. A pair that is no
    contact scores as its forms do with their empty words unmatched; a rare word makes ``RARE`` contacts at most for each list that shows it.
    """
    wide = write_table(lists.groupBy("bucket").count().where(F.col("count") > WIDE).select("bucket"), "wide_buckets")
    if wide.isEmpty():
        return None
    words, shown, cost = _word_costs(lists.join(wide, "bucket", "left_semi"), True)
    rare = write_table(cost.where(F.col("cost") <= RARE).select("bucket", "word"), "rare_words")
    marked = words.join(rare.withColumn("rare", F.lit(True)), ["bucket", "word"], "left")
    kept = F.sort_array(F.collect_list(F.struct("at", F.when(F.col("rare"), "").otherwise(F.col("word")).alias("word"))))
    masks = marked.groupBy("id").agg(kept["word"].alias("form"))
    masks = write_table(lists.select("id", "bucket", "words", "lo", "hi").join(masks, "id", "left").select("id", "bucket", F.coalesce("form", "words").alias("words"), "lo", "hi"), "list_masks")
    forms = masks.groupBy("bucket", "words").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    forms = write_table(forms.withColumn("id", F.monotonically_increasing_id()), "forms")
    of_list = write_table(masks.select("id", "bucket", "words").join(forms.select("bucket", "words", F.col("id").alias("form")), ["bucket", "words"]).select("id", "form"), "list_forms")
    near = write_table(rare_neighbours(cost), "rare_near")
    left = words.join(near, ["bucket", "word"]).select(F.col("id").alias("x"), "m", "bucket", F.col("other").alias("word"))
    right = words.select(F.col("id").alias("y"), F.col("m").alias("n"), "bucket", "word")
    fits = 2 * F.least("m", "n") >= F.lit(least) * (F.col("m") + F.col("n")) - 1e-9
    met = left.join(right, ["bucket", "word"]).where((F.col("x") != F.col("y")) & fits)
    return forms, of_list, write_table(met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "contacts")


def list_pairs(lists: DataFrame, least: float, similar: bool = True) -> DataFrame:
    """(x, y) of different lists of a bucket, each pair once, that may have a score of ``least`` (above 0) in either order."""
    keys = variants if similar else F.array
    words, shown, cost = _word_costs(lists, similar)
    # One row a list: its words by cost, cut to the prefix.
    ordered = words.join(cost, ["bucket", "word"]).groupBy("id", "bucket", "m").agg(F.sort_array(F.collect_list(F.struct("cost", "at", "word"))).alias("w"))
    ordered = ordered.withColumn("prefix", F.greatest(F.lit(0), F.size("w") - F.ceil(F.col("m") * F.lit(least) - 1e-9) + 1).cast("int"))
    probes = write_table(ordered.select("id", "bucket", "m", "prefix", F.size("w").alias("real"), F.posexplode(F.slice("w", F.lit(1), F.col("prefix"))).alias("pos", "w")).select("id", "bucket", "m", "prefix", "real", "pos", "w.word"), "probes")
    probed = write_table(probes.select("bucket", "word").distinct(), "probed")
    met = write_table(shown.drop("n").join(probed.select("bucket", F.explode(keys(F.col("word"))).alias("key")).distinct(), ["bucket", "key"]), "met")
    # Word by word which words a probe's word meets; a table of the vocabulary, not of the lists.
    near = probed.select("bucket", "word", F.explode(keys(F.col("word"))).alias("key")).join(met.withColumnRenamed("word", "other"), ["bucket", "key"])
    near = write_table(near.select("bucket", "word", "other").distinct(), "near_words")
    if similar:
        near = near.where(_one_edit("word", "other"))
    left = probes.join(near, ["bucket", "word"]).select(F.col("id").alias("x"), "m", "prefix", "real", "pos", "bucket", F.col("other").alias("word"))
    right = words.join(near.select("bucket", F.col("other").alias("word")).distinct(), ["bucket", "word"], "left_semi")
    right = right.select(F.col("id").alias("y"), F.col("m").alias("n"), "bucket", "word").distinct()
    m, n = F.col("m"), F.col("n")
    fits = ((m < n) | ((m == n) & (F.col("x") < F.col("y")))) & (2 * m >= F.lit(least) * (m + n) - 1e-9)
    got = left.join(right, ["bucket", "word"]).where(fits)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(F.col("pos"), F.lit(BITS)))
    got = got.groupBy("x", "y").agg(F.bit_or(bit).alias("hit"), F.first("m").alias("m"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("real").alias("real"))
    # Words of the prefix that met nothing are lost; the rest may all match.
    low = F.col("hit").bitwiseAND(F.lit((1 << BITS) - 1).cast("bigint"))
    most = F.bit_count(low) + F.when(F.col("hit") != low, F.col("prefix") - BITS).otherwise(0) + (F.col("real") - F.col("prefix"))
    return got.where(2 * most >= F.lit(least) * (m + n) - 1e-9).select("x", "y")


def scored_lists(lists: DataFrame, least: float, similar: bool = True) -> DataFrame:
    """(x, y, score): score of list x before list y, at least ``least``; for each order that occurs among members, and for x = y.

    The greedy score depends on the order; lists whose words are equal score 1.
    """
    there = pair_scores(lists, write_table(list_pairs(lists, least, similar), "list_pairs"), least, similar)
    return there.union(lists.select(F.col("id").alias("x"), F.col("id").alias("y"), F.lit(1.0).alias("score")))


def form_scores(forms: DataFrame, least: float) -> DataFrame:
    """As ``scored_lists``, of forms whose empty words match nothing; a form with itself only if it has some."""
    own = forms.select(F.col("id").alias("x"), F.col("id").alias("y"), (F.size(F.array_remove("words", "")) / F.size("words")).alias("score"))
    near = write_table(list_pairs(forms, least), "form_pairs")
    return pair_scores(forms, near, least).union(own.where((F.col("score") >= least - 1e-9) & (F.col("score") < 1)))


def _score(least: float, similar: bool):
    """(x, y, there, back) of (x, y, a, b, ab, ba), lists as words between blanks: ``word_score`` of a before b and of b before a where asked for, null below ``least``."""

    def of(a: list[str], b: list[str], asked: bool) -> float | None:
        total = len(a) + len(b)
        n = matched_words(a, b, math.ceil((least - 1e-9) * total / 2 - 1e-6), similar) if asked else None
        return None if n is None else 2.0 * n / total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ab, ba = (batch.column(c).to_pylist() for c in ("a", "b", "ab", "ba"))
            a, b = ([words.split(" ") for words in side] for side in (a, b))
            there, back = (pa.array([*map(of, *sides)], pa.float64()) for sides in ((a, b, ab), (b, a, ba)))
            yield pa.record_batch([batch.column("x"), batch.column("y"), there, back], names=["x", "y", "there", "back"])

    return run


def pair_scores(lists: DataFrame, near: DataFrame, least: float, similar: bool = True) -> DataFrame:
    """(x, y, score), at least ``least``, of both orders of the pairs ``near`` (x, y), where members have them so; an empty word matches nothing."""
    # Words hold no blanks: as one string a list is far shorter in a shuffle and on the way to Python.
    side = lambda a, i: lists.select(F.col("id").alias(i), F.struct(F.array_join("words", " ").alias("words"), "lo", "hi").alias(a))
    # Scores are the costly part and their rows are short, so they are dealt out by number and not by bytes.
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = near.join(side("a", "x"), "x").join(side("b", "y"), "y").repartition(parts, "x", "y")
    asked = both.select("x", "y", F.col("a.words").alias("a"), F.col("b.words").alias("b"), (F.col("a.lo") < F.col("b.hi")).alias("ab"), (F.col("b.lo") < F.col("a.hi")).alias("ba"))
    table = write_table(asked.mapInArrow(_score(least, similar), "x bigint, y bigint, there double, back double"), "list_scores")
    there = table.where(F.col("there") >= least - 1e-9).select("x", "y", F.col("there").alias("score"))
    back = table.where(F.col("back") >= least - 1e-9).select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("back").alias("score"))
    return there.union(back)


def met_members(members: DataFrame, scored: DataFrame, *columns: str, keep: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """(src, dst, score, and each of ``columns`` as l_ and r_) for the members of scored lists, src before dst.

    Members of a list that are equal in ``columns`` are a node: what depends on the list and ``columns`` is tested
    once a pair of nodes by ``keep``, from the score and, as structs, the columns of both. A node's members are short
    arrays, as many as it needs, and pairs of arrays are spelt out where they meet, so no join has a row a pair.
    """
    sized = write_table(members.groupBy("id", *columns).agg(F.ceil(F.count("*") / CHUNK).alias("chunks")), "node_sizes")
    chunk = F.pmod(F.xxhash64("scan_seq"), F.col("chunks"))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("id", *columns)]
    dealt = members.alias("m").join(sized.alias("n"), reduce(lambda a, b: a & b, same)).select("m.*", chunk.alias("chunk"))
    nodes = write_table(dealt.groupBy("id", *columns, "chunk").agg(F.collect_list("scan_seq").alias("seqs"), F.min("scan_seq").alias("lo"), F.max("scan_seq").alias("hi")), "node_members")
    side = lambda p, i: nodes.select(F.col("id").alias(i), *(F.col(c).alias(p + c) for c in (*columns, "seqs", "lo", "hi")))
    met = side("l_", "x").join(scored, "x").join(side("r_", "y"), "y").where("l_lo < r_hi")
    if keep is not None:
        ends = [F.struct(*(F.col(p + c).alias(c) for c in columns)) for p in ("l_", "r_")]
        met = met.where(keep(F.col("score"), *ends))
    # Few and short rows become many: they are dealt out by number and not by bytes.
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = ["score", *(p + c for p in ("l_", "r_") for c in columns)]
    met = met.select(*kept, "l_seqs", "r_seqs").repartition(parts)
    return met.select(*kept, F.explode("l_seqs").alias("src"), "r_seqs").select(*kept, "src", F.explode("r_seqs").alias("dst")).where("src < dst")
