"""Aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_at_levels(refs: DataFrame, upper: str, lower: str, item: str) -> DataFrame:
    """Distinct items for each upper key (level 1, lower null) and each (upper, lower), nulls included (level 2)."""
    pairs = refs.select(upper, lower, item).distinct()
    sets = pairs.groupingSets([[F.col(upper)], [F.col(upper), F.col(lower)]], F.col(upper), F.col(lower))
    return sets.agg((2 - F.grouping_id()).cast("int").alias("level"), F.count_distinct(item).alias("n"))


def counts_with_zeros(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """A row for each of ``values`` in the given order, zero included."""
    spark = df.sparkSession
    every = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{column} string, ord int")
    return every.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, "ord", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def tree_counts(df: DataFrame, *levels: str) -> DataFrame:
    """Counts at each level of a hierarchy, the columns below it null; level tells how many columns count, so that null keys are no totals."""
    return df.rollup(*levels).agg((len(levels) - F.bit_count(F.grouping_id())).cast("int").alias("level"), F.count("*").alias("n"))


def tree_with_empty(counts: DataFrame, tops: DataFrame, top: str) -> DataFrame:
    """``tree_counts`` with a zero row for each value of ``tops(top)`` that has none."""
    missing = tops.select(top).distinct().join(counts.where("level = 1"), top, "left_anti").select(top, F.lit(1).alias("level"), F.lit(0).cast("long").alias("n"))
    return counts.unionByName(missing, allowMissingColumns=True)


def facet_counts(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """One row: all rows and the number with each value."""
    return df.agg(F.count("*").alias("n_all"), *[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    """How many edges end at each node."""
    return edges.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def unambiguous(df: DataFrame, keys: Sequence[str], *identity: str) -> DataFrame:
    """Rows whose key belongs to one thing only."""
    count = df.groupBy(*keys).agg(F.count_distinct(*[F.col(c) for c in identity]).alias("quern_n")).where("quern_n = 1")
    return df.join(count, list(keys), "left_semi")


def prefix_ranges(rows: DataFrame, key: str, path: str, ordinal: str) -> DataFrame:
    """First and last ordinal of every path prefix: key, depth, prefix, first, last, n."""
    each = rows.select(key, ordinal, path, F.explode(F.when(F.size(path) > 0, F.sequence(F.lit(1), F.size(path)))).alias("depth"))
    prefix = each.withColumn("prefix", F.array_join(F.slice(F.col(path), F.lit(1), F.col("depth")), "/"))
    return prefix.groupBy(key, "depth", "prefix").agg(F.min(ordinal).alias("first"), F.max(ordinal).alias("last"), F.count("*").alias("n"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values whose numbers differ: columns, only_a, only_b."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("quern_d")).unionByName(b.select(*cols, F.lit(-1).alias("quern_d")))
    net = both.groupBy(*cols).agg(F.sum("quern_d").alias("d")).where("d <> 0")
    return net.select(*cols, F.greatest("d", F.lit(0)).cast("long").alias("only_a"), F.greatest(-F.col("d"), F.lit(0)).cast("long").alias("only_b"))


def first_seen_order(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values in the order in which they first occur."""
    return df.groupBy(column).agg(F.min(order).alias("first_seen"))


def merged_intervals(df: DataFrame, key: Sequence[str], start: str, end: str, gap: float = 0) -> DataFrame:
    """Intervals joined where one begins no more than ``gap`` after all before it end: key, island, start, end, n."""
    order = Window.partitionBy(*key).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("quern_new", F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("quern_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*key, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


def pivot_counts(df: DataFrame, group: str, tests: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row a group: how many rows pass each test."""
    return df.groupBy(group).agg(F.count("*").alias("n"), *[F.count_if(t).alias(name) for name, t in tests])


def observed(df: DataFrame, group: Sequence[str], at: str) -> DataFrame:
    """How often and when each group was seen: n, first, last."""
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def label_sets(df: DataFrame, group: Sequence[str], label: str, out: str) -> DataFrame:
    """The distinct labels of each group, sorted; for labels of a small closed set."""
    pairs = df.select(*group, label).distinct()
    return pairs.groupBy(*group).agg(F.sort_array(F.collect_list(label)).alias(out))
