"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of a lexicon, its proximity to second-person words, shares of capitals and of
marks, and rates of obfuscated spelling. The lexicon is a short fixed list and, learned from the labelled
rows, whole words and word beginnings that toxic texts have and others don't. At most ``SAMPLE`` labelled
rows are fitted on: one half learns the lexicon, of the other half two thirds grow the trees and the rest
calibrates them, each row by the number of labelled ones that it stands for. Labels are read for fitting alone; language, source and id are never features.

Null and empty texts have all features 0 and get the score of that. Texts of any length are read whole.
Repeated rows get equal scores. Labels that are null, of unknown documents or contradict each other are ignored;
with labels of one kind only, the score is that kind's share. Of an id with several texts the one with the least
hash is learned from. Ties in a split go to the first feature and cut. Only the named columns are read, so others
can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.columns import crc_of_id, small_batches
from tallyfold.llm.sampling import sampled_texts

SAMPLE, LEXICON, WORDS = 12_000, 400, 400_000
GRAMS = (4, 5, 6, 7, 8)
DEPTH, TREES, RATE, BINS = 3, 60, 0.2, 32
#: Insults, and words of the second person.
INSULTS = "idiot moron stupid scum trash loser pathetic worthless disgusting clown dumb fool jerk imbecile"
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes vosotros"
_LEET = str.maketrans("013457@$!", "oieastasi")
_WORD = re.compile(r"\S+")
_EDGE = re.compile(r"^\W+|\W+$")
_INNER = re.compile(r"[\W_]")
FEATURES = ("hits", "density", "weight", "top", "weight_rate", "near_you", "hidden", "hidden_rate", "capitals", "shouted", "marks", "obfuscated", "length")


def _grams(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in GRAMS if k < len(word))]


def _plain(token: str) -> str:
    return _EDGE.sub("", token).lower()


class Features(dict):
    """Features of a text under a lexicon of grams with weights.

    Maps a token to the code of what is special about it, 0 for nothing; each distinct token is looked at
    once, and tokens that are special in the same way share a code, so the table of codes stays small.
    """

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.you = set(SECOND_PERSON.split())
        self.codes: dict[tuple, int] = {(0.0, 0.0, 0.0, 0.0, 0.0): 0}
        self.table = np.zeros((1, 5))

    def _weight(self, word: str) -> float:
        lexicon = self.lexicon
        return max((lexicon[g] for g in _grams(word) if g in lexicon), default=0.0)

    def __missing__(self, token: str) -> int:
        word = token.lower() if token.isalpha() else _plain(token)
        weight, hidden, odd = self._weight(word), 0.0, 0.0
        if not word.isalpha():
            inner = _INNER.sub("", word.translate(_LEET))
            odd = float(inner != word)
            hidden = self._weight(inner) if odd and not weight else 0.0
        # weight, weight once spelled plainly, second person, shouted, obfuscated
        what = (weight, hidden, float(word in self.you), float(len(word) > 2 and token.isupper()), odd)
        code = self.codes.get(what)
        if code is None:
            code = self.codes[what] = len(self.codes)
            self.table = np.array(list(self.codes))
        if len(self) >= WORDS:
            self.clear()
        self[token] = code
        return code

    def row(self, text: str | None) -> list[float]:
        tokens = (text or "").split()
        if not tokens:
            return [0.0] * len(FEATURES)
        n = len(tokens)
        codes = np.fromiter(map(self.__getitem__, tokens), np.int64, n)
        at = np.flatnonzero(codes)
        weight, hidden, you, shouted, odd = self.table[codes[at]].T
        spots, where = at[weight > 0], at[you > 0]
        near = 0.0
        if len(spots) and len(where):
            k = np.searchsorted(where, spots)
            left = np.abs(spots - where[np.maximum(k - 1, 0)])
            right = np.abs(where[np.minimum(k, len(where) - 1)] - spots)
            near = float((np.minimum(left, right) <= 5).sum())
        chars = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        capitals = int(chars[65:91].sum())
        letters = capitals + int(chars[97:123].sum()) + int(chars[192:].sum())
        n_hidden = float((hidden > 0).sum())
        return [
            float(len(spots)), len(spots) / n, float(weight.sum()), float(weight.max(initial=0.0)), weight.sum() / n, near, n_hidden, n_hidden / n,
            capitals / max(letters, 1), shouted.sum() / n, int(chars[33] + chars[63]) / n, odd.sum() / n, math.log1p(n),
        ]


def learned_lexicon(rows: DataFrame, most: int = LEXICON) -> dict[str, float]:
    """Grams of (text, label) rows with the strongest evidence for label 1, and their log odds."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ones = Counter(), Counter()
        docs = [0, 0]
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {_plain(t) for t in set(_WORD.findall(text or ""))}
                grams = {g for w in words if w for g in _grams(w)}
                n.update(grams)
                docs[label] += 1
                if label:
                    ones.update(grams)
        n[""], ones[""] = sum(docs), docs[1]
        names = list(n)
        for lo in range(0, len(names), 50_000):
            part = names[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([n[g] for g in part], pa.int64()), pa.array([ones[g] for g in part], pa.int64())], names=["gram", "n", "ones"])

    counts = rows.select("text", "label").repartition(4).mapInArrow(counted, "gram string, n bigint, ones bigint")
    sums = counts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    whole = sums.where("gram = ''").first()
    if not whole or not 0 < whole["ones"] < whole["n"]:
        return {}
    n1, n0 = whole["ones"], whole["n"] - whole["ones"]
    odds = F.log((F.col("ones") + 0.5) / (n1 + 1.0)) - F.log((F.col("n") - F.col("ones") + 0.5) / (n0 + 1.0))
    found = sums.where(f"gram <> '' AND ones >= {max(3, min(6, n1 // 50))}").withColumn("odds", odds).where("odds >= 2.5")
    best = found.orderBy((F.col("ones") * F.col("odds")).desc(), "gram").limit(most).collect()
    return {r["gram"]: r["odds"] for r in best}


def boosted_trees(x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray], list[tuple]]:
    """Log-loss boosting on binned features: (start, cuts per feature, trees); a tree is its splits by level and leaf values."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)
    share = min(max(y.mean(), 1e-4), 1 - 1e-4)
    start = math.log(share / (1 - share))
    score = np.full(len(y), start)
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        levels = []
        for depth in range(DEPTH):
            width = 1 << depth
            best = [(1e-6, -1, 0)] * width
            for j in range(x.shape[1]):
                cell = node * (BINS + 1) + binned[:, j]
                g = np.bincount(cell, grad, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                h = np.bincount(cell, hess, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
                for k in range(width):
                    b = int(gain[k].argmax())
                    if gain[k, b] > best[k][0]:
                        best[k] = (gain[k, b], j, b)
            split = [(j, b) for _, j, b in best]
            levels.append(split)
            at = np.array([j for j, _ in split])[node]
            limit = np.array([b for _, b in split])[node]
            right = (at >= 0) & (binned[np.arange(len(y)), np.maximum(at, 0)] > limit)
            node = node * 2 + right
        leaf = np.bincount(node, grad, 1 << DEPTH) / (np.bincount(node, hess, 1 << DEPTH) + 1) * RATE
        score = score + leaf[node]
        trees.append((levels, leaf))
    return start, cuts, trees


def margins(model: tuple, x: np.ndarray) -> np.ndarray:
    start, cuts, trees = model
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)
    score = np.full(len(x), start)
    every = np.arange(len(x))
    for levels, leaf in trees:
        node = np.zeros(len(x), np.int64)
        for split in levels:
            at = np.array([j for j, _ in split])[node]
            limit = np.array([b for _, b in split])[node]
            node = node * 2 + ((at >= 0) & (binned[every, np.maximum(at, 0)] > limit))
        score += leaf[node]
    return score


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Points (x, value) of the non-decreasing fit of weighted least squares, by pooling adjacent violators."""
    pools: list[list[float]] = []
    values, at = np.unique(x, return_inverse=True)
    weight = np.ones(len(x)) if weight is None else weight
    mass = np.bincount(at, weight)
    for v, t, w in zip(values.tolist(), (np.bincount(at, weight * y) / mass).tolist(), mass.tolist()):
        pools.append([t, w, v, v])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    points = [(edge, p[0]) for p in pools for edge in sorted({p[2], p[3]})]
    return np.array([p[0] for p in points]), np.array([p[1] for p in points])


def fit(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, usable: Column, sample: int) -> tuple[dict[str, float], object]:
    """(lexicon, model): model is (trees, calibration), or a constant where the labels are of one kind."""
    marked = labels.where(F.col(label).isNotNull() & usable).select(doc_id, (F.col(label) > 0).cast("int").alias("label"))
    rows = sampled_texts(documents, marked, doc_id, text, sample).withColumn("fold", F.pmod(F.xxhash64(doc_id, F.lit(7)), F.lit(6)))
    lexicon = {w: 6.0 for w in INSULTS.split()} | learned_lexicon(rows.where("fold < 3"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Features(lexicon)
        for batch in batches:
            x = [look.row(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), *batch.columns[1:]], names=["x", "label", "fold", "weight"])

    got = rows.where("fold >= 3").select("text", "label", "fold", "weight").mapInArrow(measured, "x array<double>, label int, fold bigint, weight double").collect()
    x, y, fold = np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["label"] for r in got], float), np.array([r["fold"] for r in got])
    weight = np.array([r["weight"] for r in got], float)
    grow = fold < 5
    if not len(y) or len(set(y[grow])) < 2:
        return lexicon, float(np.average(y, weights=weight)) if len(y) else 0.0
    trees = boosted_trees(x[grow], y[grow])
    held = ~grow if (~grow).sum() >= 20 else np.ones(len(y), bool)
    return lexicon, (trees, isotonic(margins(trees, x[held]), y[held], weight[held]))


def score(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", cut: float = 0.7, sample: int = SAMPLE,
) -> DataFrame:
    """doc_id, held_out, score and predicted for each row; rows that are held out are never learned from."""
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(documents.sparkSession)
    out = F.pmod(crc_of_id(F.col(doc_id)), F.lit(3)) == 1
    lexicon, model = fit(documents, labels, doc_id, text, label, ~out, sample)

    def scored(batches: Iterator[pa.RecordBatch], step: int = 1024) -> Iterator[pa.RecordBatch]:
        look = Features(lexicon)
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                if isinstance(model, float):
                    p = np.full(batch.num_rows, model)
                else:
                    margin = margins(model[0], np.array([look.row(t) for t in batch.column(1).to_pylist()]))
                    # The calibrated step, and a trace of the margin for order within a step.
                    p = 0.998 * np.interp(margin, *model[1]) + 0.002 / (1 + np.exp(-margin))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(p)], names=["id", "score"])

    kind = to_arrow_type(documents.schema[doc_id].dataType)
    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    got = rows.mapInArrow(scored, f"id {documents.schema[doc_id].dataType.simpleString()}, score double").withColumnRenamed("id", doc_id)
    return got.select(doc_id, out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
