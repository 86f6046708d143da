"""Words and their similarity."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[a-z0-9]+|[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]"


def words(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9, and each CJK character by itself."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def parse_list(text: str) -> list[str]:
    """Items between commas, semicolons and white space, lower-cased, without empty ones."""
    return [x.strip().lower() for x in re.split(r"[,，;；\s]+", text or "") if x.strip()]


def near_word(x: Column, y: Column) -> Column:
    """At most one edit apart."""
    return F.levenshtein(x, y, 1).between(0, 1)


def _bound(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def common_words(a: Column, b: Column, similar: bool = True) -> Column:
    """Greedy one-to-one matches in the order of ``a``: the first equal unused word of ``b``, else the first near one.

    A used word of ``b`` becomes empty, which matches nothing.
    """

    def step(state: Column, x: Column) -> Column:
        left = state["left"]
        same = F.array_position(left, x)
        if similar:
            near = F.array_position(F.transform(left, lambda y: (F.length(y) >= 2) & near_word(x, y)), F.lit(True))
            found = F.when(same > 0, same).when(F.length(x) >= 2, near).otherwise(F.lit(0).cast("long"))
        else:
            found = same
        use = lambda at: F.struct(
            F.transform(left, lambda y, i: F.when(i + 1 == at, F.lit("")).otherwise(y)).alias("left"),
            (state["n"] + F.when(at > 0, 1).otherwise(0)).alias("n"),
        )
        return _bound(found, use)

    return F.aggregate(a, F.struct(b.alias("left"), F.lit(0).alias("n")), step, lambda s: s["n"])


def word_score(a: Column, b: Column, similar: bool = True) -> Column:
    """2 * matches / (words of both), 0 where either has none."""
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * common_words(a, b, similar) / total)


def _one_edit(x: str, y: str) -> bool:
    """Whether two different words are one edit apart."""
    if len(x) < len(y):
        x, y = y, x
    if len(x) - len(y) > 1:
        return False
    at, end = 0, len(y)
    while at < end and x[at] == y[at]:
        at += 1
    return x[at + 1 :] == (y[at:] if len(x) > end else y[at + 1 :])


def matched_words(a: list[str], b: list[str], need: int, similar: bool = True) -> int | None:
    """``common_words`` of lists in Python, None if below ``need``; an empty word matches nothing."""
    left, misses = list(b), len(a) - need
    for x in a:
        if x and x in left:
            left[left.index(x)] = ""
            continue
        if similar and len(x) >= 2:
            at = next((i for i, y in enumerate(left) if len(y) >= 2 and _one_edit(x, y)), None)
            if at is not None:
                left[at] = ""
                continue
        misses -= 1
        if misses < 0:
            return None
    return misses + need


def variants(word: Column) -> Column:
    """The word, and it with one character left out: words at most one edit apart share one of these."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.when(F.length(word) >= 2, F.array_distinct(F.concat(F.array(word), cut))).otherwise(F.array(word))


def size_ratio_ok(a: Column, b: Column) -> Column:
    """the larger is at most four times the smaller; zero only goes with zero."""
    return F.when((a == 0) | (b == 0), a == b).otherwise(F.greatest(a, b) <= 4 * F.least(a, b))


def duration_ok(a: Column, b: Column) -> Column:
    """either unknown (0), or the smaller at least 85 % of the larger, in whole seconds."""
    return (a == 0) | (b == 0) | (F.least(a, b) >= F.expr("1L") * F.floor(F.greatest(a, b) * 85 / 100))


def duration_score(a: Column, b: Column) -> Column:
    """1 from 90 %, 0.5 from 80 %, else 0; 0 where either is unknown."""
    small, big = F.least(a, b), F.greatest(a, b)
    return F.when((a == 0) | (b == 0), 0.0).when(small >= F.floor(big * 9 / 10), 1.0).when(small >= F.floor(big * 8 / 10), 0.5).otherwise(0.0)


def comparable_tag(artist: Column, title: Column) -> Column:
    """artist or title is not blank."""
    return (F.trim(F.coalesce(artist, F.lit(""))) != "") | (F.trim(F.coalesce(title, F.lit(""))) != "")
