"""Word shingles as Spark columns (JVM only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of anything but these six white-space characters.
SPACE = r"[ \t-\r]+"


def words(text: Column) -> Column:
    """Lower-case words of a text; an empty array for null, empty and blank texts."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")


def shingle_hashes(ws: Column, n: int) -> Column:
    """A 64-bit hash for each run of ``n`` words, in order, repeats included; empty if there are fewer words."""
    at = F.when(F.size(ws) >= n, F.sequence(F.lit(0), F.size(ws) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(n), *[F.get(ws, i + j) for j in range(n)]))


def sequence_hash(ws: Column) -> Column:
    """A hash of the whole word sequence, for texts shorter than a shingle."""
    return F.xxhash64(F.lit(0), ws)


def of(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made(value)`` with ``value`` computed once a row, however often ``made`` uses it."""
    return F.transform(F.array(value), made)[0]
