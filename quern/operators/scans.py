"""Running sums, last values and the like over keys of any length.

A window has all rows of a key in one task. Here rows are dealt by ranges of (key, order),
so a long key lies in many ranges. Each range is folded by itself, the results of a key's
ranges are scanned (one row a range), and every row then takes what the ranges before its
own carry over. No task has more than a range, whatever the keys are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sinks.scratch import checkpointed


@dataclass(frozen=True)
class Scan:
    """A running value of the rows of a key up to this one; ``before`` leaves this row out.

    kind: sum (nulls count nothing; 0 at first), max, min, last (of the values that are not
    null), or lag (of the row before, whatever it is; needs ``before``).
    """

    kind: str
    value: Column
    before: bool = False

    def folded(self, values: Column) -> Column:
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](values)

    def joined(self, carry: Column, own: Column) -> Column:
        """What comes of the ranges before and this one."""
        if self.kind == "sum":
            return F.coalesce(carry, F.lit(0)) + F.coalesce(own, F.lit(0))
        if self.kind in ("max", "min"):
            return {"max": F.greatest, "min": F.least}[self.kind](carry, own)
        return F.coalesce(own, carry)


def scanned(df: DataFrame, key: Sequence[str], order: Sequence[str], totals: dict[str, Column] | None = None, **scans: Scan) -> DataFrame:
    """``df`` with a column for each of ``scans``, and each of ``totals`` (aggregates by sum over all rows of the key).

    ``order`` should tell the rows of a key apart; rows alike in it are in one range.
    """
    named = df
    for name, s in scans.items():
        wrapped = F.struct(s.value.alias("v")) if s.kind == "lag" else F.when(s.value.isNotNull(), F.struct(s.value.alias("v"))) if s.kind == "last" else s.value
        named = named.withColumn(f"scan__v_{name}", wrapped)
    for name, value in (totals or {}).items():
        named = named.withColumn(f"scan__t_{name}", value)
    by = [*key, *order]
    rows = checkpointed(named.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("scan__part", F.spark_partition_id()), "scan")

    inside = Window.partitionBy("scan__part", *key).orderBy(*order)
    last = lambda s: s.kind in ("last", "lag")
    parts = rows.groupBy("scan__part", *key).agg(*[_range_value(s, n, order) for n, s in scans.items()], *[F.sum(f"scan__t_{n}").alias(f"scan__t_{n}") for n in totals or {}])
    whole = Window.partitionBy(*key)
    earlier = whole.orderBy("scan__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    # only a key at the edge of a range goes on in others: two rows a range at most, however many keys there are
    carried = parts.withColumn("scan__n", F.count("*").over(whole)).select(
        F.col("scan__part").alias("scan__p"), "scan__n", *[F.col(k).alias(f"scan__k{i}") for i, k in enumerate(key)],
        *[(F.last(f"scan__v_{n}", ignorenulls=True) if last(s) else s.folded(F.col(f"scan__v_{n}"))).over(earlier).alias(f"scan__c_{n}") for n, s in scans.items()],
        *[F.sum(f"scan__t_{n}").over(whole).alias(f"scan__w_{n}") for n in totals or {}],
    ).where("scan__n > 1")
    out = rows
    for name, s in scans.items():
        frame = inside.rowsBetween(Window.unboundedPreceding, -1 if s.before else Window.currentRow)
        value = F.col(f"scan__v_{name}")
        own = F.lag(value).over(inside) if s.kind == "lag" else F.last(value, ignorenulls=True).over(frame) if s.kind == "last" else s.folded(value).over(frame)
        out = out.withColumn(f"scan__o_{name}", own)
    for name in totals or {}:
        out = out.withColumn(f"scan__o_{name}", F.sum(f"scan__t_{name}").over(Window.partitionBy("scan__part", *key)))
    on = F.col("scan__part") == F.col("scan__p")
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"scan__k{i}"))
    both = out.join(F.broadcast(carried), on, "left")
    told = []
    for n, s in scans.items():
        value = s.joined(F.col(f"scan__c_{n}"), F.col(f"scan__o_{n}"))
        told.append((value["v"] if last(s) else value).alias(n))
    return both.select(*df.columns, *told, *[F.coalesce(f"scan__w_{n}", f"scan__o_{n}").alias(n) for n in totals or {}])


def _range_value(s: Scan, name: str, order: Sequence[str]) -> Column:
    """What a whole range comes to."""
    value = F.col(f"scan__v_{name}")
    if s.kind in ("last", "lag"):
        return F.max_by(value, F.when(value.isNotNull(), F.struct(*order))).alias(f"scan__v_{name}")
    return s.folded(value).alias(f"scan__v_{name}")


def runs(df: DataFrame, key: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """Numbers runs of consecutive rows with equal ``value`` from 1 in column run."""
    seen = scanned(df.withColumn("quern_value", value), key, order, quern_before=Scan("lag", F.struct(F.col("quern_value")), before=True))
    fresh = F.when(F.col("quern_before").isNull() | ~F.col("quern_before.quern_value").eqNullSafe(F.col("quern_value")), 1).otherwise(0)
    return scanned(seen.withColumn("quern_fresh", fresh), key, order, run=Scan("sum", F.col("quern_fresh").cast("long"))).select(*df.columns, "run")


def heading_stack(df: DataFrame, key: Sequence[str], order: Sequence[str], level: str, label: str, depth: int) -> DataFrame:
    """Current heading of each level 1..depth: the last of that level, unless a higher one came since. Columns h1..h<depth>."""
    place = F.struct(*order)
    scans = {f"quern_l{k}": Scan("last", F.when(F.col(level) == k, F.struct(place.alias("at"), F.col(label).alias("label")))) for k in range(1, depth + 1)}
    scans |= {f"quern_u{k}": Scan("last", F.when(F.col(level) < k, place)) for k in range(1, depth + 1)}
    seen = scanned(df, key, order, **scans)
    shown = [F.when(F.col(f"quern_u{k}").isNull() | (F.col(f"quern_l{k}.at") > F.col(f"quern_u{k}")), F.col(f"quern_l{k}.label")).alias(f"h{k}") for k in range(1, depth + 1)]
    return seen.select(*df.columns, *shown)


def within_budget(df: DataFrame, key: Sequence[str], order: Sequence[str], size: Column, budget: int) -> DataFrame:
    """Rows from the start whose sizes together stay within the budget; used: size so far, left_out: rows that no longer fit."""
    seen = scanned(df, key, order, used=Scan("sum", size))
    told = scanned(seen, key, order, totals={"left_out": F.when(F.col("used") <= budget, 0).otherwise(1)})
    return told.where(F.col("used") <= budget)


def clamped(spans: DataFrame, key: Sequence[str], start: str, end: str, *more: str) -> DataFrame:
    """Spans cut so that each begins where all before it end; those with nothing left are dropped. ``more`` tells spans with the same ends apart."""
    seen = scanned(spans, key, [start, end, *more], quern_reach=Scan("max", F.col(end), before=True))
    begun = F.greatest(F.col(start), F.col("quern_reach"))
    return seen.withColumn(start, begun).where(F.col(start) < F.col(end)).drop("quern_reach")


def latest_before(df: DataFrame, key: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds the last ``value`` that is not null of the rows before each."""
    return scanned(df, key, order, **{name: Scan("last", value, before=True)})
