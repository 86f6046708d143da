"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade > k) is the logistic of (weights . features - threshold k): one set of weights over hashed
features for all grades, and ordered thresholds. The features are a text's words, their shapes (letters
and digits folded, marks kept) and repeats, hashed into ``BUCKETS`` and divided by the number of words.
The result is the expected grade and the probability of the grades from ``from_grade`` up, on which
selection cuts.

At most ``SAMPLE`` rated rows are fitted on. Null and empty texts have no features and get the grade of
the thresholds alone. Texts of any length are read whole. Repeated rows get equal grades. Ratings may be any
numbers, half grades too. Those that are null, of unknown documents or contradict each other are ignored; with
one grade only, it is everyone's. Of an id with several texts the one with the least hash is learned from. Only
the named columns are read, so others can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.columns import crc_of_id, small_batches
from tallyfold.llm.sampling import sampled_texts

BUCKETS, SAMPLE, EPOCHS, BATCH, RATE, DECAY, WORDS = 1 << 16, 8000, 12, 64, 0.5, 1e-5, 400_000
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def _slots(word: str) -> tuple[int, int]:
    """The buckets of a word and of its shape."""
    shape = _DIGITS.sub("0", _LETTERS.sub(lambda m: "a" if len(m[0]) < 12 else "b" if len(m[0]) < 25 else "c", word))
    return crc32(word.lower().encode("utf-8", "replace")) % (BUCKETS // 2), BUCKETS // 2 + crc32(shape.encode("utf-8", "replace")) % (BUCKETS // 2 - 1)


class _Weights(dict):
    """The summed weight of a word's buckets; each distinct word is hashed once."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) >= WORDS:
            self.clear()
        a, b = _slots(word)
        self[word] = got = self.weights[a] + self.weights[b]
        return got


def _counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their share of the words; the last bucket is of words that repeat the one before."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    slots = [s for w in words for s in _slots(w)] + [BUCKETS - 1] * sum(a == b for a, b in zip(words, words[1:]))
    at, n = np.unique(np.array(slots), return_counts=True)
    return at, n / len(words)


def fit_ordinal(at: list[np.ndarray], x: list[np.ndarray], grade: np.ndarray, grades: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Adagrad on the likelihood, each row by its ``weight``; the thresholds stay in order as sums of exponentials."""
    weight = np.ones(len(grade)) if weight is None else weight / weight.mean()
    w, gw = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    share = np.array([np.average(grade > k, weights=weight) for k in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    raw = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    gr = np.full(len(raw), 1e-6)
    order = np.random.default_rng(0)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(EPOCHS):
        for rows in np.array_split(order.permutation(len(grade)), max(1, len(grade) // BATCH)):
            cuts = np.concatenate([[raw[0]], raw[0] + np.cumsum(np.exp(raw[1:]))])
            where, values = np.concatenate([at[i] for i in rows]), np.concatenate([x[i] for i in rows])
            owner = np.repeat(np.arange(len(rows)), [len(at[i]) for i in rows])
            f = np.bincount(owner, w[where] * values, len(rows))
            g = grade[rows]
            edge = np.concatenate([[-np.inf], cuts, [np.inf]])
            hi, lo = sig(edge[g + 1] - f), sig(edge[g] - f)
            hi, lo = np.where(g == grades - 1, 1.0, hi), np.where(g == 0, 0.0, lo)
            p = np.maximum(hi - lo, 1e-9)
            d_hi, d_lo = weight[rows] * hi * (1 - hi) / p, weight[rows] * lo * (1 - lo) / p
            df = -(d_hi - d_lo) / len(rows)  # of the log likelihood by f
            grad = np.bincount(where, df[owner] * values, BUCKETS) - DECAY * w
            gw += grad**2
            w += RATE * grad / np.sqrt(gw)
            dc = (np.bincount(g, d_hi, grades)[:-1] - np.bincount(g, d_lo, grades)[1:]) / len(rows)
            back = dc[::-1].cumsum()[::-1]
            graw = np.concatenate([[back[0]], back[1:] * np.exp(raw[1:])])
            gr += graw**2
            raw += 0.1 * graw / np.sqrt(gr)
    return w, np.concatenate([[raw[0]], raw[0] + np.cumsum(np.exp(raw[1:]))])


def grade(
    documents: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", text: str = "text", rating: str = "quality", from_grade: float | None = None,
    cut: float = 0.5, sample: int = SAMPLE,
) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability and kept; grades are the distinct ratings in order (at most 32)."""
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(documents.sparkSession)
    out = F.pmod(crc_of_id(F.col(doc_id)), F.lit(3)) == 1
    marked = ratings.where(F.col(rating).isNotNull() & ~out).select(doc_id, F.col(rating).cast("double").alias("rating"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_counts(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([g[1].astype(np.float32) for g in got], pa.list_(pa.float32())), *batch.columns[1:]],
                names=["at", "x", "rating", "weight"],
            )

    # Features of at most ``sample`` rows.
    rows = sampled_texts(documents, marked, doc_id, text, sample, "rating").select("text", "rating", "weight").mapInArrow(featured, "at array<int>, x array<float>, rating double, weight double").toArrow()
    rated, weight = rows.column("rating").to_numpy(), rows.column("weight").to_numpy()
    levels = np.unique(rated)
    if len(levels) > 32:
        raise ValueError("at most 32 grades")
    at, x = ([np.asarray(v) for v in rows.column(c).combine_chunks().to_numpy(zero_copy_only=False)] for c in ("at", "x"))
    del rows
    w, cuts = fit_ordinal([a.astype(np.int64) for a in at], x, np.searchsorted(levels, rated), len(levels), weight) if len(levels) > 1 else (np.zeros(BUCKETS), np.empty(0))
    values = levels.astype(float) if len(levels) else np.zeros(1)
    tail_from = max(1, len(levels) - 1) if from_grade is None else int(np.searchsorted(levels, from_grade))
    shared = documents.sparkSession.sparkContext.broadcast(w.astype(np.float32))  # BUCKETS numbers
    kind = to_arrow_type(documents.schema[doc_id].dataType)

    def graded(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[pa.RecordBatch]:
        weight = _Weights(shared.value)
        again = weight.weights[BUCKETS - 1]
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                f = np.zeros(batch.num_rows)
                for i, t in enumerate(batch.column(1).to_pylist()):
                    words = (t or "").split()
                    if words:
                        f[i] = (sum(map(weight.__getitem__, words)) + again * sum(map(str.__eq__, words, words[1:]))) / len(words)
                above = 1 / (1 + np.exp(np.clip(cuts[None, :] - f[:, None], -30, 30)))  # P(grade > k)
                expected = values[0] + above @ np.diff(values) if len(cuts) else np.full(len(f), values[0])
                tail = above[:, tail_from - 1] if 0 < tail_from <= len(cuts) else np.full(len(f), float(tail_from <= 0 or not len(cuts)))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(expected), pa.array(tail)], names=["id", "expected_grade", "tail_probability"])

    texts = documents.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    got = texts.mapInArrow(graded, f"id {documents.schema[doc_id].dataType.simpleString()}, expected_grade double, tail_probability double").withColumnRenamed("id", doc_id)
    return got.select(doc_id, out.alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= cut).alias("kept"))
