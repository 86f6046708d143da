"""Quality rules as a bitmask ledger (native).

Each rule is evaluated once per document; the ledger keeps the measurements and one failure bit per
rule. A policy is a versioned set of bits, so judging under another policy, or asking what a rule alone
rejects, is bitwise arithmetic over the ledger and never another pass over the texts.

Null and empty texts measure 0 everywhere and fail ``few_words``. Repeated rows are judged alike. A text
of any length is measured whole, within its own row. An empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.columns import OWN, settled, spaced_words, text_or_empty

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT, MAX_MEAN_WORD = 30, 50, 40

#: Rule -> (bit, condition of failure over the measurements, each a whole number).
RULES = {
    "few_words": (0, lambda c: c("n_words") < MIN_WORDS),
    "repeated_words": (1, lambda c: 100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words")),
    "symbols": (2, lambda c: 100 * c("n_symbols") > MAX_SYMBOL_PERCENT * c("n_words")),
    "duplicate_lines": (3, lambda c: 100 * c("n_dup_lines") > MAX_DUP_LINE_PERCENT * c("n_lines")),
    "long_words": (4, lambda c: c("word_chars") > MAX_MEAN_WORD * c("n_words")),
}
BIT = {rule: 1 << bit for rule, (bit, _) in RULES.items()}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Version -> the bits that reject a document. A published version never changes.
POLICIES = {
    "base-1": BASE,
    "full-1": BASE | BIT["symbols"] | BIT["duplicate_lines"] | BIT["long_words"],
}
DEFAULT_POLICY = "full-1"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _covered(starts: Column, width: int) -> Column:
    """Positions covered by windows of ``width`` words at the sorted ``starts``."""
    parts = F.transform(starts, lambda s, i: F.least(F.lit(width), F.coalesce(F.get(starts, i + 1) - s, F.lit(width))))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a struct ``__tf_m`` of the measurements of ``text``."""
    n = lambda name: F.col(OWN + name)
    df = df.withColumn(OWN + "words", spaced_words(F.col(text)))
    df = df.withColumn(OWN + "n", F.size(OWN + "words").cast("long"))
    window = lambda i: F.xxhash64(*(F.get(n("words"), i + k) for k in range(3)))
    df = df.withColumn(
        OWN + "keys",
        F.when(n("n") >= 3, F.transform(F.sequence(F.lit(0), n("n").cast("int") - 3), window)).otherwise(F.array().cast("array<bigint>")),
    )
    lines = F.filter(F.split(text_or_empty(F.col(text)), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn(OWN + "lines", lines)
    df = df.withColumn(
        OWN + "pairs",
        F.when(
            F.size(F.array_distinct(n("keys"))) < F.size(n("keys")),
            F.sort_array(F.transform(n("keys"), lambda k, i: F.struct(k.alias("k"), i.alias("i")))),
        ),
    )
    same = lambda p, q: F.coalesce(p["k"] == q["k"], F.lit(False))
    twice = F.filter(n("pairs"), lambda p, i: same(p, F.get(n("pairs"), i - 1)) | same(p, F.get(n("pairs"), i + 1)))
    df = df.withColumn(OWN + "starts", F.sort_array(F.transform(twice, lambda p: p["i"])))
    measured = F.struct(
        n("n").alias("n_words"),
        F.length(F.regexp_replace(text_or_empty(F.col(text)), r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text_or_empty(F.col(text)), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size(n("lines")).cast("long").alias("n_lines"),
        (F.size(n("lines")) - F.size(F.array_distinct(n("lines")))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(n("starts"), 3), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return settled(df, OWN + "m", measured).drop(*(OWN + x for x in ("words", "n", "keys", "lines", "pairs", "starts")))


def fail_mask(measures: Column) -> Column:
    """One bit for each rule that fails."""
    mask = F.lit(0)
    for bit, failed in RULES.values():
        mask = mask.bitwiseOR(F.when(failed(lambda name: measures[name]), F.lit(1 << bit)).otherwise(F.lit(0)))
    return mask


def rejected(mask: Column, policy: str = DEFAULT_POLICY) -> Column:
    return mask.bitwiseAND(F.lit(POLICIES[policy])) != 0


def ledger(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, every measurement and ``fail_mask`` for each row of ``df``."""
    kept = df.select(F.col(doc_id), F.col(text).alias(OWN + "text"))
    got = with_measures(kept, OWN + "text").withColumn(OWN + "mask", fail_mask(F.col(OWN + "m")))
    return got.select(F.col(doc_id), *(F.col(OWN + "m")[x].alias(x) for x in MEASURES), F.col(OWN + "mask").alias("fail_mask"))


def judge(book: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The ledger with ``base_failed``, ``kept`` and the policy's version."""
    base = F.col("fail_mask").bitwiseAND(F.lit(BASE)) != 0
    return book.withColumns({"base_failed": base, "kept": ~base & ~rejected(F.col("fail_mask"), policy), "policy": F.lit(policy)})


def ablations(book: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """For each rule: documents that fail it, and those it alone makes ``policy`` reject. One grouped pass."""
    active = F.col("fail_mask").bitwiseAND(F.lit(POLICIES[policy]))
    counts = book.groupBy(active.alias("active"), F.col("fail_mask")).count()
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(b).alias("bit")) for r, b in BIT.items()))).alias("r")
    return (
        counts.select("*", rules)
        .groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit"))
        .agg(
            F.sum(F.when(F.col("fail_mask").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("active") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("n_alone"),
        )
    )


def keep_clean(df: DataFrame, text: str = "text", policy: str = DEFAULT_POLICY) -> DataFrame:
    """The rows of ``df`` that ``policy`` keeps, with the columns of ``df``."""
    return with_measures(df, text).where(~rejected(fail_mask(F.col(OWN + "m")), policy)).select(*df.columns)
