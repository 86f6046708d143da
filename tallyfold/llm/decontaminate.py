"""Benchmark decontamination as a prefix-filtered set join (native).

A benchmark window is the run of ``window`` consecutive item words (a shorter item is one window). To
occur in a document, all of a window's word shingles must occur there, so its rarest shingle is a
necessary prefix token. Shingles are ordered by their count over all documents; documents join on the
rarest one alone, position and length bounds cut what can't fit, and the item-sized run of words is then
compared word by word.

The documents are read a fixed number of times whatever the benchmark's size: once to count the benchmark's
distinct shingles, once to find the windows' rarest ones, and once more only where those are too many to
broadcast with their words. Each broadcast is behind a count (``KEYS``, ``ANCHORS``); beyond it the shingles
and their places are shuffled to a written table, so that a shingle of a third of the documents can be split,
and the documents with a candidate are read again for the comparison. Equal windows of many items are one row.

Nulls, empty texts and texts without words have no words, hit nothing and are still listed. Very long texts
are taken whole. Ties for the rarest shingle go to the first. Rows that repeat a doc_id with another text are
judged by themselves, equal rows alike. Items without id count for ``n_hit`` alone; items without words are
none. An empty table of documents gives an empty result, one of items hits nothing. Other columns are not
read, so their names can't clash, and ``keep_clean`` hands them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.columns import ALNUM_WORD, alnum_words, text_or_empty
from tallyfold.llm.sampling import BROADCAST_IDS, without
from tallyfold.plans.storage import write_table

WINDOW, SHINGLE = 10, 3
#: Distinct shingles of the benchmark, and windows with their words, that are broadcast at most.
KEYS, ANCHORS = 1_000_000, 50_000


def _shingle(words: Column, at: Column, k: Column, sizes: list[int]) -> Column:
    """The key of the ``k`` words from ``at`` on, ``k`` one of ``sizes``."""
    keys = [F.xxhash64(*(F.get(words, at + j) for j in range(size))) for size in sizes]
    out = keys[-1]
    for size, key in zip(sizes[:-1], keys):
        out = F.when(k == size, key).otherwise(out)
    return out


def _positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each word position and size with that many words from there on, with the shingle's key."""
    # A filter on n would be pushed below the words and split the text twice.
    least = min(sizes)
    starts = F.when(F.col("n") >= least, F.sequence(F.lit(0), F.col("n") - least)).otherwise(F.array().cast("array<int>"))
    out = docs.select("*", F.explode(starts).alias("pos"))
    if len(sizes) == 1:
        return out.withColumn("key", _shingle(F.col("words"), F.col("pos"), F.lit(least), sizes))
    keys = [F.when(F.col("pos") + k <= F.col("n"), _shingle(F.col("words"), F.col("pos"), F.lit(k), [k])) for k in sizes]
    return out.select("*", F.explode(F.array_compact(F.array(*keys))).alias("key"))


def item_windows(items: DataFrame, item_id: str, text: str, window: int, shingle: int) -> DataFrame:
    """(item_id, wid, len, k, win, keys): each item's windows, their words and their shingles' keys."""
    words = items.select(F.col(item_id).alias("item_id"), alnum_words(F.col(text)).alias("words")).withColumn("n", F.size("words"))
    return (
        words.where("n > 0")
        .withColumns({"len": F.least(F.lit(window), F.col("n")), "k": F.least(F.lit(shingle), F.col("n"))})
        .select("item_id", "len", "k", F.explode(F.expr("transform(sequence(0, n - len), i -> slice(words, i + 1, len))")).alias("win"))
        .withColumn("wid", F.md5(F.array_join("win", " ").cast("binary")))
    )


def find_windows(docs: DataFrame, windows: DataFrame, most_keys: int, most_anchors: int) -> DataFrame:
    """(doc_id, th, start, len, wid): every occurrence of a window in a document."""
    none = docs.where(F.lit(False)).select("doc_id", "th", F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit("").alias("wid"))
    sizes = sorted(r["k"] for r in windows.select("k").distinct().collect())  # at most ``shingle`` values
    if not sizes:
        return none
    offsets = windows.select("wid", "len", "win", "k", F.explode(F.expr("sequence(0, len - k)")).alias("off")).withColumn("key", _shingle(F.col("win"), F.col("off"), F.col("k"), sizes))
    keys = write_table(offsets.select("key").distinct(), "keys")
    seen = _positions(docs.select("words", "n"), sizes).select("key")
    if keys.count() <= most_keys:
        counts = seen.join(F.broadcast(keys), "key").groupBy("key").agg(F.count("*").alias("freq"))
    else:
        counts = seen.groupBy("key").agg(F.count("*").alias("freq")).join(keys, "key", "left_semi")
    counts = write_table(counts, "key_counts")
    rarest = offsets.join(counts, "key", "left").groupBy("wid").agg(
        F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), F.col("off"), F.col("key"))).alias("p"), F.first("len").alias("len"), F.first("win").alias("win")
    )
    # A window whose rarest shingle never occurs can't occur.
    anchors = write_table(rarest.where("p.freq > 0").select("wid", "len", "win", F.col("p.off").alias("off"), F.col("p.key").alias("key")), "anchors")
    found = ["doc_id", "th", "start", "len", "wid"]
    fits = "start >= 0 AND start + len <= n"
    same = F.slice("words", F.col("start") + 1, F.col("len")) == F.col("win")
    if anchors.count() <= most_anchors:
        near = _positions(docs, sizes).join(F.broadcast(anchors), "key").withColumn("start", F.col("pos") - F.col("off"))
        return near.where(fits).where(same).select(*found)
    places = _positions(docs, sizes).select("doc_id", "th", "n", "pos", "key").join(anchors.drop("win"), "key").withColumn("start", F.col("pos") - F.col("off"))
    places = write_table(places.where(fits).select(F.struct("doc_id", "th").alias("at"), "start", "len", "wid").distinct(), "places")
    ids = write_table(places.select("at").distinct(), "place_ids")
    at = F.struct("doc_id", "th")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select("words", at.alias("at")).join(F.broadcast(ids) if few else ids, "at", "left_semi")
    return places.join(texts, "at").join(anchors.select("wid", "win"), "wid").where(same).select("at.doc_id", "at.th", "start", "len", "wid")


def contamination(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE, most_keys: int = KEYS, most_anchors: int = ANCHORS,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (their ids as sorted texts) and contaminated, for each document row."""
    return _judged(documents, items, doc_id, text, item_id, item_text, window, shingle, most_keys, most_anchors).drop("__tf_same")


def _judged(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE, most_keys: int = KEYS, most_anchors: int = ANCHORS,
) -> DataFrame:
    """``contamination`` and __tf_same, the text's hash."""
    base = documents.select(F.col(doc_id).alias("doc_id"), text_or_empty(F.col(text)).alias("text")).withColumn("th", F.xxhash64("text"))
    docs = base.select("doc_id", "th", alnum_words(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    windows = write_table(item_windows(items, item_id, item_text, window, shingle), "windows")
    hits = write_table(find_windows(docs, windows.dropDuplicates(["wid"]), most_keys, most_anchors).distinct(), "hits")
    spans = hits.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "len")).alias("spans"))
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))))
    named = windows.where(F.col("item_id").isNotNull()).select("wid", F.col("item_id").cast("string").alias("item")).distinct()
    listed = (
        hits.select("doc_id", "th", "wid").distinct().join(named, "wid").groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    key = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])
    marked = spans.select("doc_id", "th", n_hit.alias("n_hit"))
    marked = marked.join(listed, key(marked, listed), "left").select(marked["doc_id"], marked["th"], "n_hit", "items")
    every = base.select("doc_id", "th", F.regexp_count("text", F.lit(ALNUM_WORD)).cast("long").alias("n_words"))
    return every.join(marked, key(every, marked), "left").select(
        every["doc_id"].alias(doc_id), "n_words", F.coalesce(F.col("n_hit"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), every["th"].alias("__tf_same"),
    )


def keep_clean(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents`` without an occurrence of an item's window, with their columns; rows that share an id, or have none, are judged each by its text."""
    return without(documents, _judged(documents, items, doc_id, text).where("contaminated"), doc_id, F.xxhash64(text_or_empty(F.col(text))))
