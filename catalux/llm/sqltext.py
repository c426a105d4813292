"""Words, lines and shingles as Spark SQL expressions (no Python in the tasks)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of maximal runs outside ``\\x20 \\x09-\\x0D``; empty for null, empty and blank texts."""
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)),
               lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(
                   F.split(t, r"[\x20\x09-\x0D]+")))


def shingles(w: Column, size: int) -> Column:
    """64-bit hash of every window of ``size`` words, in text order; none for shorter texts."""
    return F.when(F.size(w) >= size, F.transform(
        F.slice(w, F.lit(1), F.size(w) - (size - 1)),
        lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)])
    )).otherwise(F.array().cast("array<bigint>"))
