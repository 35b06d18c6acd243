"""Window operators: runs, stacks, segments, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """Numbers runs of consecutive rows with equal ``value`` from 1 in column run."""
    w = Window.partitionBy(*partition).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(value) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("quern_new", changed).withColumn("run", F.sum("quern_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")).drop("quern_new")


def heading_stack(df: DataFrame, partition: Sequence[str], order: Sequence[str], level: str, label: str, depth: int) -> DataFrame:
    """Current heading of each level 1..depth: the last of that level, unless a higher one came since. Columns h1..h<depth>."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    out = df.withColumn("quern_at", place)
    for k in range(1, depth + 1):
        out = out.withColumn(f"quern_{k}", F.last(F.when(F.col(level) == k, F.struct("quern_at", label)), ignorenulls=True).over(w))
        out = out.withColumn(f"quern_up{k}", F.max(F.when(F.col(level) < k, F.col("quern_at"))).over(w))
    shown = [F.when(F.col(f"quern_up{k}").isNull() | (F.col(f"quern_{k}.quern_at") > F.col(f"quern_up{k}")), F.col(f"quern_{k}.{label}")).alias(f"h{k}") for k in range(1, depth + 1)]
    return out.select(*df.columns, *shown)


def segments(df: DataFrame, partition: Sequence[str], start: str, length: Column) -> DataFrame:
    """Adds end: where the next one starts, or ``length``."""
    w = Window.partitionBy(*partition).orderBy(start)
    return df.withColumn("end", F.lead(start).over(w)).withColumn("end", F.coalesce("end", length))


def first_occurrences(df: DataFrame, group: str, term: str, order: str, most: int) -> DataFrame:
    """First row of each term of a group; of these the first ``most`` in order."""
    first = df.withColumn("quern_rn", F.row_number().over(Window.partitionBy(group, term).orderBy(order))).where("quern_rn = 1")
    return first.withColumn("quern_rn", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("quern_rn") <= most).drop("quern_rn")


def keyed_dedup(df: DataFrame, keys: Sequence[str], order: str, keep: str = "first") -> DataFrame:
    """One row a key. ``last`` keeps the last row's values at the place of the first (column ``order``)."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(F.col(order).asc() if keep == "first" else F.col(order).desc()))
    out = df.withColumn("quern_rn", rank).withColumn("quern_min", F.min(order).over(w)).where("quern_rn = 1")
    return out.withColumn(order, F.col("quern_min")).drop("quern_rn", "quern_min")


def version_chain(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Adds previous (value of the version before) and changed."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("previous", F.lag(value).over(w)).withColumn("changed", ~F.col("previous").eqNullSafe(F.col(value)))


def within_budget(df: DataFrame, partition: Sequence[str], order: Sequence[str], size: Column, budget: int) -> DataFrame:
    """Rows from the start whose sizes together stay within the budget; used: size so far, left_out: rows that no longer fit."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = df.withColumn("used", F.sum(size).over(w))
    total = F.count("*").over(Window.partitionBy(*partition))
    fits = F.count_if(F.col("used") <= budget).over(Window.partitionBy(*partition))
    return marked.withColumn("left_out", total - fits).where(F.col("used") <= budget)


def ordinals(df: DataFrame, partition: Sequence[str], *order: Column) -> DataFrame:
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def clamped(spans: DataFrame, partition: Sequence[str], start: str, end: str) -> DataFrame:
    """Spans cut so that each begins where all before it end; those with nothing left are dropped."""
    w = Window.partitionBy(*partition).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    begun = F.greatest(F.col(start), F.coalesce(F.max(end).over(w), F.col(start)))
    return spans.withColumn("quern_start", begun).where(F.col("quern_start") < F.col(end)).withColumn(start, F.col("quern_start")).drop("quern_start")


def consecutive(df: DataFrame, partition: Sequence[str], order: str, number: str) -> DataFrame:
    """One row a partition: ok if its numbers are 1, 2, 3 ... in order."""
    w = Window.partitionBy(*partition).orderBy(order)
    return df.withColumn("quern_ok", F.row_number().over(w) == F.col(number)).groupBy(*partition).agg(F.bool_and("quern_ok").alias("ok"), F.count("*").alias("n"))


def gaps_between(df: DataFrame, partition: Sequence[str], number: str, most: int) -> DataFrame:
    """Rows that lie more than ``most`` after the one before them, with that one's number as previous."""
    w = Window.partitionBy(*partition).orderBy(number)
    return df.withColumn("previous", F.lag(number).over(w)).where(F.col(number) - F.col("previous") > most)


def top_per_group(df: DataFrame, group: Sequence[str], most: int, *order: Column) -> DataFrame:
    """The first ``most`` rows of each group in the given order, numbered from 1 in rn."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w).cast("long")).where(F.col("rn") <= most)


def page_of(df: DataFrame, page: int, size: int, *order: Column) -> DataFrame:
    """Page ``page`` (from 1) of the rows in the given order."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)
