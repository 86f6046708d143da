"""Bit hashes: distance, assembly and text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 63


def hamming(a: Column, b: Column) -> Column:
    """The number of different bits."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def threshold_bits(block: Column) -> Column:
    """Of 64 numbers, the first left out; bit i is set where number i of the rest is above their mean."""
    ac = F.transform(F.slice(block, 2, HASH_BITS), lambda x: x.cast("double"))
    mean = F.aggregate(ac, F.lit(0.0), lambda s, x: s + x) / F.lit(float(HASH_BITS))
    bit = lambda m: lambda v, i: F.when(v > m, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))
    # The mean is the argument of a lambda, or it would be summed up anew for each number.
    return F.get(F.transform(F.array(mean), lambda m: F.aggregate(F.transform(ac, bit(m)), F.lit(0).cast("bigint"), lambda x, y: x.bitwiseOR(y))), F.lit(0))


def signature_text(sig: Column) -> Column:
    """16 hex digits for each hash, joined by commas."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ",")


def signature_of(text: Column) -> Column:
    """X9 backwards; null where any part is not 1 to 16 hex digits."""
    parts = F.split(text, ",")
    ok = F.forall(parts, lambda p: p.rlike("^[0-9a-fA-F]{1,16}$"))
    return F.when(ok, F.transform(parts, lambda p: F.conv(p, 16, -10).cast("bigint")))


def hash_hex(raw: Column) -> Column:
    """Lower-case hex of a binary hash."""
    return F.lower(F.hex(raw))


def hash_of_hex(text: Column, size: int = 32) -> Column:
    """X8 backwards; null for another length or other digits."""
    return F.when(text.rlike(f"^[0-9a-fA-F]{{{2 * size}}}$"), F.unhex(text))


def frame_score(a: Column, b: Column, radius: int) -> Column:
    """The mean of both directions' share of frames with a frame of the other within ``radius``; 0 if either is empty."""
    share = lambda x, y: F.size(F.filter(x, lambda p: F.exists(y, lambda q: hamming(p, q) <= radius))) / F.size(x)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise((share(a, b) + share(b, a)) / 2.0)
