"""Bounded, repeatable samples of labelled rows for fitting, and rows without listed ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.plans.storage import write_table

#: Ids sent to all executors at most; more are joined by shuffling.
BROADCAST_IDS = 1_000_000


#: Different labels at most.
LABELS = 512


def class_shares(sizes: dict[object, int], bound: int) -> dict[object, int]:
    """How many of each class are taken, ``bound`` together at most: in proportion, but of a rare class an eighth of an equal part at least."""
    least = bound // (8 * max(len(sizes), 1))
    floors = {c: min(n, least) for c, n in sizes.items()}
    spare, rest = bound - sum(floors.values()), sum(sizes.values()) - sum(floors.values())
    return {c: floors[c] + min(n - floors[c], (n - floors[c]) * spare // max(rest, 1)) for c, n in sizes.items()}


def bounded_ids(labelled: DataFrame, key: str, label: str, bound: int) -> DataFrame:
    """(key, label, weight): at most ``bound`` ids, of each class those with the least hashes; small enough to broadcast by its bound.

    An id whose labels contradict each other is no evidence and is left out. ``weight`` is how many ids of its class one stands for.
    """
    agreed = labelled.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias(label), F.max(label).alias("__tf_max"))
    agreed = write_table(agreed.where(F.col(label) == F.col("__tf_max")).drop("__tf_max"), "labels")
    found = agreed.groupBy(label).agg(F.count("*").alias("n")).limit(LABELS + 1).collect()
    if len(found) > LABELS:
        raise ValueError(f"at most {LABELS} different labels")
    sizes = {r[label]: r["n"] for r in found}
    shares = class_shares(sizes, bound)
    # A hash below a class's share is taken without a sort; the limit holds the bound against chance.
    draw = F.xxhash64(key).cast("double") / 2.0**64 + 0.5
    part, weight = F.lit(0.0), F.lit(1.0)
    for value, n in sizes.items():
        here = F.col(label) == F.lit(value)
        part = F.when(here, shares[value] / n if shares[value] < n else 2.0).otherwise(part)
        weight = F.when(here, n / max(shares[value], 1)).otherwise(weight)
    return agreed.where(draw < part).withColumn("weight", weight).orderBy(draw, key).limit(bound)


def sampled_texts(documents: DataFrame, labelled: DataFrame, key: str, text: str, bound: int, label: str = "label") -> DataFrame:
    """(key, text, label, weight) of the sampled ids, a row an id: its whole text, of several the one with the least hash."""
    texts = documents.select(F.col(key), F.col(text).cast("string").alias("text"))
    met = texts.join(F.broadcast(bounded_ids(labelled, key, label, bound)), key)
    return met.groupBy(key, label, "weight").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select(key, "text", label, "weight")


def without(rows: DataFrame, gone: DataFrame, key: str, same: Column | None = None) -> DataFrame:
    """``rows`` whose ``key`` is not in ``gone``; a list of checked size spares the texts a shuffle.

    With ``same``, a hash of what a row is judged by, only rows go whose ``key`` and hash are those of a row in ``gone``, which has it as __tf_same.
    """
    ids = write_table(gone.select(F.col(key).alias("__tf_id"), *([] if same is None else ["__tf_same"])).distinct(), "gone")
    few = ids.count() <= BROADCAST_IDS
    met = rows[key].eqNullSafe(F.col("__tf_id"))
    if same is not None:
        met = met & (same == F.col("__tf_same"))
    return rows.join(F.broadcast(ids) if few else ids, met, "left_anti")
