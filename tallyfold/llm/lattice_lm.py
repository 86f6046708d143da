"""Language-model scores: the marginal likelihood of a text over all its segmentations into pieces and words.

The pieces come from an existing vocabulary file, whose scores weight them at first (they are merge ranks, so
by Zipf's law over the rank). Training words are arcs of their own beside the spellings, each with its count
less a discount, which is learned from how many words occur once and twice; the discounts' mass is what spelled
words get. ``ROUNDS`` rounds of forward-backward over all segmentations of all distinct training words turn the
pieces' weights into expected counts. A word's probability sums over every way to spell it and its own arc, by
the forward recursion in log space, and a text's is the product over its words and its end. Word arcs, spelled
words and the end together have probability 1, and so have the pieces: a spelled word is a marked piece and
any number of others. Beside it stands the word unigram score with add-half smoothing, which is no
distribution over texts, as all unseen words share one word's probability.

All counts are over all training texts, in a distributed table of one row per distinct word, which also
gets the word's expected counts and lattice likelihood. The most frequent words, ``HEAVY`` at most, are sent to all workers; every
other word of a text finds its row by a join, where no key is frequent.

Null and empty texts are one end token. Very long texts and words are scored whole. Repeated rows get
equal scores, each its own row; no order enters, so ties need no rule. Without training texts, all counts are 0
and the vocabulary's scores weight alone. An empty table gives an empty result. Only the two named columns are
read, so others can't clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.columns import LOWER, UPPER, crc_of_id, small_batches
from tallyfold.llm.sentence_pieces import MARK, piece_model
from tallyfold.plans.storage import write_table

HEAVY, FLUSH, PRIOR_COUNT, PRIOR_SHIFT, ROUNDS = 120_000, 100_000, 2000.0, 10.0, 3
#: Characters of words in one lattice; bits of a hash that are looked up first.
CHARS, HEAD = 50_000, 18
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TO_LOWER).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, train, seen): partial counts, given on whenever many words have gathered."""
    seen, train = Counter(), Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        names = list(seen)
        for lo in range(0, len(names), 50_000):
            part = names[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.binary()).cast(pa.string()), pa.array([train[w] for w in part], pa.int64()), pa.array([seen[w] for w in part], pa.int64())], names=["word", "train", "seen"]
            )
        seen.clear()
        train.clear()

    for batch in batches:
        for text, learn in zip(batch.column(0), batch.column(1).to_pylist()):
            words = _words(text.as_py())
            seen.update(words)
            if learn:
                train.update(words)
            if len(seen) >= FLUSH:
                yield from rows()
    yield from rows()


def prior_counts(model_path: str) -> np.ndarray:
    """PRIOR_COUNT dealt to the pieces by the vocabulary's scores; bytes and control pieces have the last rank."""
    model = piece_model(model_path)
    rank = np.full(model.known, float(model.known))
    for piece, i in model.ids.items():
        rank[i] = model.rank[piece]
    prior = 1 / (rank + PRIOR_SHIFT)
    return prior * (PRIOR_COUNT / prior.sum())


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log of the sum of exp of each run of ``x`` that begins at ``first``."""
    top = np.maximum.reduceat(x, first)
    return top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff(first, append=len(x)))), first))


def _next_hash(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The hashes of texts that are one character longer."""
    return (keys ^ codes) * np.uint64(0x9E3779B97F4A7C15) + (keys >> np.uint64(29))


class Lattice:
    """Forward and backward sums over all segmentations of many words at once, in log space.

    The words stand marked in one text with a line end after each, so that a node is a place in the text. Arcs are
    the pieces that occur, and the bytes of each character that is no piece.
    """

    def __init__(self, model_path: str, log10: np.ndarray):
        self.model = piece_model(model_path)
        if not self.model.lines:
            raise ValueError("a vocabulary without line ends is needed")
        self.logs = log10 * math.log(10)
        # Pieces of each length: their hashes in order, ids and characters, and which hash heads occur.
        self.tables = []
        ids: dict[int, list[tuple[str, int]]] = {}
        for piece, i in self.model.ids.items():
            ids.setdefault(len(piece), []).append((piece, i))
        for n, own in sorted(ids.items()):
            codes = np.array([[ord(c) for c in p] for p, _ in own], np.uint64)
            keys = np.zeros(len(own), np.uint64)
            for k in range(n):
                keys = _next_hash(keys, codes[:, k])
            order = np.argsort(keys)
            if (np.diff(keys[order]) == 0).any():
                raise ValueError("two pieces share a hash")
            heads = np.zeros(1 << HEAD, bool)
            heads[keys >> np.uint64(64 - HEAD)] = True
            self.tables.append((n, keys[order], np.array([i for _, i in own])[order], codes[order], heads))

    def _found(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token, start, end) of every piece that occurs, by rolling hashes; characters are compared where hashes agree."""
        codes = codes.astype(np.uint64)
        keys, size, out = np.zeros(len(codes), np.uint64), 0, []
        for n, hashes, tokens, chars, heads in self.tables:
            for k in range(size, min(n, len(codes))):
                keys = _next_hash(keys[: len(codes) - k], codes[k:])
            size = n
            if n > len(codes):
                break
            at = np.flatnonzero(heads[keys >> np.uint64(64 - HEAD)])
            row = np.searchsorted(hashes, keys[at])
            ok = hashes[np.minimum(row, len(hashes) - 1)] == keys[at]
            at, row = at[ok], row[ok]
            same = np.ones(len(at), bool)
            for k in range(n):
                same &= codes[at + k] == chars[row, k]
            at, row = at[same], row[same]
            out.append((tokens[row], at, at + n))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3

    def _arcs(self, words: list[str]) -> None:
        model = self.model
        text = "".join(f"{MARK}{w}\n" for w in words)
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        tokens, starts, ends = self._found(codes)
        odd = sorted(set(text) - model.ids.keys() - {"\n"})
        self.odd = [[model.byte_ids[b] for b in c.encode("utf-8", "replace")] for c in odd]
        place = np.flatnonzero(np.isin(codes, np.array([ord(c) for c in odd], np.uint32))) if odd else np.empty(0, np.int64)
        which = np.searchsorted(np.array([ord(c) for c in odd], np.uint32), codes[place])
        logs = np.concatenate([self.logs, [self.logs[ids].sum() for ids in self.odd]]) if odd else self.logs
        token, start, end = np.concatenate([tokens, model.known + which]), np.concatenate([starts, place]), np.concatenate([ends, place + 1])
        order = np.argsort(end, kind="stable")
        self.token, self.start, self.end = token[order], start[order], end[order]
        self.weight = logs[self.token]
        self.last = np.flatnonzero(codes == ord("\n"))
        self.first = np.concatenate([[0], self.last[:-1] + 1])
        self.owner = np.searchsorted(self.last, self.start)
        self.nodes = len(codes)

    def _swept(self, to: np.ndarray, other: np.ndarray, weight: np.ndarray, depth: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Log sums at every node, from ``begin`` on in order of ``depth``, the distance of an arc's ``to`` from it."""
        out = np.full(self.nodes, -np.inf)
        out[begin] = 0.0
        # Arcs come in order of ``to``; few depths sort by radix.
        order = np.argsort(depth.astype(np.uint16) if len(depth) and depth.max() < 1 << 16 else depth, kind="stable")
        to, other, weight, depth = to[order], other[order], weight[order], depth[order]
        edges = np.searchsorted(depth, np.arange(1, (depth[-1] if len(depth) else 0) + 2))
        for lo, hi in zip(edges[:-1], edges[1:]):
            if lo < hi:
                at = to[lo:hi]
                first = np.flatnonzero(np.diff(at, prepend=-1))
                out[at[first]] = _sums(out[other[lo:hi]] + weight[lo:hi], first)
        return out

    def _batches(self, words: list[str]) -> Iterator[np.ndarray]:
        """Indices of words of like length, CHARS characters together."""
        order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
        sizes = np.fromiter((len(words[i]) + 2 for i in order), np.int64, len(order))
        return iter(np.split(order, np.flatnonzero(np.diff(np.cumsum(sizes) // CHARS)) + 1))

    def log10(self, words: list[str]) -> np.ndarray:
        """log10 of the sum over all segmentations of each marked word."""
        out = np.zeros(len(words))
        for at in self._batches(words) if words else ():
            self._arcs([words[i] for i in at])
            out[at] = self._swept(self.end, self.start, self.weight, self.end - self.first[self.owner], self.first)[self.last] / math.log(10)
        return out

    def expected(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """How often each piece occurs in segmentations drawn by their probability, each word ``times`` times."""
        out = np.zeros(self.model.known)
        for at in self._batches(words) if words else ():
            self._arcs([words[i] for i in at])
            there = self._swept(self.end, self.start, self.weight, self.end - self.first[self.owner], self.first)
            by = np.argsort(self.start, kind="stable")
            back = self._swept(self.start[by], self.end[by], self.weight[by], (self.last[self.owner] - self.start)[by], self.last)
            share = np.exp(there[self.start] + self.weight + back[self.end] - there[self.last[self.owner]]) * times[at][self.owner]
            got = np.bincount(self.token, share, self.model.known + len(self.odd))
            out += got[: self.model.known]
            for ids, n in zip(self.odd, got[self.model.known :]):
                np.add.at(out, ids, n)
        return out


class Weights:
    """What is behind all probabilities: expected counts of pieces, the words' discount, spelled words and ends."""

    def __init__(self, tokens: int, distinct: int, once: int, twice: int, ends: int, model_path: str):
        self.model_path = model_path
        self.discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
        self.spelled, self.ends = self.discount * distinct + 1, ends + 1
        self.total = tokens + 1 + self.ends
        self.pieces = self.prior = prior_counts(model_path)

    def piece_log10(self) -> np.ndarray:
        return np.log10(self.pieces / self.pieces.sum())

    def end_log10(self) -> float:
        return math.log10(self.ends / self.total)

    def word_log10(self, ways: np.ndarray, train: np.ndarray) -> np.ndarray:
        """Of words with the sums ``ways`` over their spellings and the counts ``train``."""
        ways = ways + math.log10(self.spelled / self.total)
        own = np.log10(np.where(train > 0, (train - self.discount) / self.total, 1.0))
        return np.where(train > 0, np.maximum(ways, own) + np.log10(1 + 10 ** -np.abs(ways - own)), ways)

    def learned(self, words: DataFrame) -> Weights:
        """After one round of forward-backward over the training words of (word, train); one row a piece reaches the driver."""
        path, logs, discount = self.model_path, words.sparkSession.sparkContext.broadcast(self.piece_log10()), self.discount

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(path, logs.value)
            n = np.zeros(lattice.model.known)
            for batch in batches:
                n += lattice.expected(batch.column(0).to_pylist(), np.full(batch.num_rows, discount))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["piece", "n"])

        got = words.where("train > 0").select("word").mapInArrow(counted, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        after = copy(self)
        after.pieces = self.prior.copy()
        after.pieces[got.column("piece").to_numpy()] += got.column("n").to_numpy()
        return after


def _scored(batches: Iterator[pa.RecordBatch], heavy: dict[bytes, tuple[float, float, int]], step: int = 256) -> Iterator[pa.RecordBatch]:
    """What the heavy words give, and the rest with their counts."""
    for whole in batches:
        for lo in range(0, whole.num_rows, step):
            batch = whole.slice(lo, step)
            tokens, known, base, score, rest, times, ends = [], [], [], [], [], [], [0]
            for text in batch.column(2).to_pylist():
                words = _words(text)
                n_known, b, s = 0, 0.0, 0.0
                for w, n in Counter(words).items():
                    got = heavy.get(w)
                    if got is None:
                        rest.append(w)
                        times.append(n)
                    else:
                        b += n * got[0]
                        s += n * got[1]
                        n_known += n * got[2]
                tokens.append(len(words) + 1)
                known.append(n_known)
                base.append(b)
                score.append(s)
                ends.append(len(rest))
            pairs = pa.StructArray.from_arrays([pa.array(rest, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], names=["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)],
                names=["id", "held_out", "n_tokens", "known", "base", "score", "rest"],
            )


def frequent_words(words: DataFrame, most: int) -> DataFrame:
    """The words of the highest classes of frequency that are ``most`` words together at most.

    A class is an eighth of a doubling, so a few hundred counts settle the cut and no top list is merged.
    """
    level = F.floor(F.log2("seen") * 8)
    sizes = sorted(((r["level"], r["n"]) for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, cut = 0, None
    for at, n in sizes:
        total += n
        if total > most:
            break
        cut = at
    return words.where(level >= cut) if cut is not None else words.where(F.lit(False))


def lm_scores(
    documents: DataFrame, model_path: str, held_out: Column | None = None, doc_id: str = "doc_id", text: str = "text", heavy: int = HEAVY, rounds: int = ROUNDS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) for each row."""
    small_batches(documents.sparkSession)
    spark = documents.sparkSession
    out = F.pmod(crc_of_id(F.col(doc_id)), F.lit(5)) == 1 if held_out is None else held_out
    texts = documents.select(F.col(doc_id).alias("id"), out.alias("held_out"), F.col(text).cast("string").alias("text"))
    partial = texts.select("text", (~F.col("held_out")).alias("learn")).mapInArrow(_counted, "word string, train bigint, seen bigint")
    counts = write_table(partial.groupBy("word").agg(F.sum("train").alias("train"), F.sum("seen").alias("seen")), "words")
    of = lambda n: F.count_if(F.col("train") == n)
    sums = counts.agg(F.sum("train").alias("n"), F.count_if(F.col("train") > 0).alias("v"), of(1).alias("once"), of(2).alias("twice")).first()
    ends = texts.where("NOT held_out").count()
    total, distinct = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    floor = math.log10(total + 0.5 * (distinct + 1))
    weights = Weights(sums["n"] or 0, sums["v"], sums["once"], sums["twice"], ends, model_path)
    for _ in range(rounds if sums["v"] else 0):
        weights = weights.learned(counts)
    end_log = weights.end_log10()
    shared = spark.sparkContext.broadcast(weights)  # a number for each piece of the vocabulary

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model_path, shared.value.piece_log10())
        for batch in batches:
            got = shared.value.word_log10(lattice.log10(batch.column(0).to_pylist()), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], names=["word", "train", "seen", "lattice"])

    words = write_table(counts.mapInArrow(spelled, "word string, train bigint, seen bigint, lattice double"), "lattice")
    top = frequent_words(words, heavy).select("word", "train", "lattice").toArrow()  # at most ``heavy`` rows
    train = top.column("train").to_numpy()
    table = dict(zip(map(str.encode, top.column("word").to_pylist()), zip((np.log10(train + 0.5) - floor).tolist(), top.column("lattice").to_pylist(), (train > 0).astype(int).tolist())))
    frequent = spark.sparkContext.broadcast(table)
    kind = documents.schema[doc_id].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, score double, rest array<struct<word:string,n:bigint>>"
    scored = write_table(texts.mapInArrow(lambda it: _scored(it, frequent.value), schema).withColumn("rid", F.monotonically_increasing_id()), "scored")
    rare = scored.select("rid", F.inline("rest")).join(words.drop("seen"), "word")
    base = F.col("n") * (F.log10(F.col("train") + 0.5) - floor)
    rare = rare.groupBy("rid").agg(F.sum(base).alias("b"), F.sum(F.col("n") * F.col("lattice")).alias("s"), F.sum(F.when(F.col("train") > 0, F.col("n")).otherwise(0)).alias("k"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.drop("rest").join(rare, "rid", "left").select(
        F.col("id").alias(doc_id), "held_out", "n_tokens", (F.col("known") + zero("k") + int(ends > 0)).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b") + (math.log10(ends + 0.5) - floor)).alias("base_score"), (F.col("score") + zero("s") + end_log).alias("score"),
    )
