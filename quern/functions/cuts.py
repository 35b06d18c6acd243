"""Spans of a text by Spark's own functions: no Python runs.

``split`` and ``regexp_extract_all`` give the parts of a text in order, and running sums of
their lengths give the places. Places are code points, ends exclusive. Patterns are Java's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start: int, end: int, text: string>>"
#: Running sums of so many doublings, for arrays of up to two to this power items; longer ones are added item by item.
DOUBLINGS = 16


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def _moved_and_added(by: int) -> Callable[[Column], Column]:
    def step(x: Column) -> Column:
        moved = F.concat(F.array_repeat(F.lit(0), by), F.slice(x, F.lit(1), F.greatest(F.size(x) - by, F.lit(0))))
        return F.when(F.size(x) > by, F.zip_with(x, moved, lambda a, b: a + b)).otherwise(x)

    return step


def running_sums(numbers: Column) -> Column:
    """For each item the sum up to it. Arrays are added to themselves, moved by 1, 2, 4 ... places: n log n steps."""
    out = numbers
    for k in range(DOUBLINGS):
        out = once(out, _moved_and_added(1 << k))
    zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("sums"))
    long = F.aggregate(numbers, zero, lambda acc, n: F.struct((acc["sum"] + n).alias("sum"), F.array_append(acc["sums"], acc["sum"] + n).alias("sums")), lambda acc: acc["sums"])
    return F.when(F.size(numbers) > 1 << DOUBLINGS, long).otherwise(out)


def lengths(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.length(p))


def _placed(parts: Column) -> Column:
    """(start, end, text) of parts that follow one another."""
    return once(F.struct(parts.alias("p"), running_sums(lengths(parts)).alias("e")), lambda s: F.zip_with(s["p"], s["e"], lambda p, e: F.struct((e - F.length(p)).alias("start"), e.alias("end"), p.alias("text"))))


def pieces(text: Column, begins: str) -> Column:
    """A text cut wherever ``begins`` matches; together the pieces are the text. Null and empty texts have none."""
    parts = F.filter(F.split(text, f"(?={begins})", -1), lambda p: p != "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast(SPANS)).otherwise(once(parts, _placed))


def sections(text: Column, begins: str) -> Column:
    """A text cut where matches of ``begins`` begin that are found one after another from the left.

    ``begins`` may take white space before a head: where pieces would be blank, they belong
    to the head after them, as one match takes both.
    """
    cut = pieces(text, begins)

    def joined(ps: Column) -> Column:
        blank = lambda p: ~p["text"].rlike(r"(?U)\S")
        kept = F.filter(ps, lambda p, i: (i == 0) | ~blank(F.get(ps, i - 1)))
        ended = once(kept, lambda ks: F.transform(ks, lambda k, i: F.struct(k["start"].alias("start"), F.coalesce(F.get(ks, i + 1)["start"], F.length(text)).alias("end"))))
        return F.when(F.exists(ps, blank), F.transform(ended, lambda k: F.struct(k["start"], k["end"], F.substr(text, k["start"] + 1, k["end"] - k["start"]).alias("text")))).otherwise(ps)

    return once(cut, joined)


def matches(text: Column, pattern: str) -> Column:
    """Every match of ``pattern`` (never an empty one) from the left as (start, end, text). Null texts have none."""
    t = F.coalesce(text, F.lit(""))
    both = F.struct(F.split(t, pattern, -1).alias("gaps"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("found"))

    def placed(s: Column) -> Column:
        upto = running_sums(F.zip_with(s["gaps"], s["found"], lambda g, f: F.length(g) + F.coalesce(F.length(f), F.lit(0))))  # the last gap has no match
        return once(upto, lambda ends: F.zip_with(s["found"], F.slice(ends, F.lit(1), F.size(s["found"])), lambda f, e: F.struct((e - F.length(f)).alias("start"), e.alias("end"), f.alias("text"))))

    return once(both, lambda s: F.when(F.size(s["found"]) == 0, F.array().cast(SPANS)).otherwise(placed(s)))
