"""Native column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs without ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Runs of digits, letters and everything beyond ASCII; Java matches this three times as fast as what it leaves out.
ALNUM_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Prefix of working columns, so that none of a caller's columns is hidden.
OWN = "__tf_"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def spaced_words(text: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(text), F.lit(SPACED_WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; ``lower`` does the same where every character is ASCII, and faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def alnum_words(text: Column) -> Column:
    """Words of letters and digits, A-Z lower-cased: the whole text at once if it is ASCII, else word by word."""
    text = text_or_empty(text)
    pick = lambda x: F.regexp_extract_all(x, F.lit(ALNUM_WORD), F.lit(0))
    return F.when(F.length(text) == F.octet_length(text), pick(F.lower(text))).otherwise(F.transform(pick(text), ascii_lower))


def crc_of_id(doc_id: Column) -> Column:
    """CRC-32 of the id in decimal; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a column that stands for itself.

    A filter on an ordinary column is pushed below its projection, which repeats the expression, and all it is
    made of, wherever the filter names it; through a generator, here of one row for each row, none is pushed.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


#: Bytes of a batch of texts on its way to Python; Spark's own bound is eight times that, for each task at once.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ``BATCH_BYTES``, unless their bound was chosen already."""
    if spark.conf.get(_BATCH) == f"{64 << 20}b":
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
