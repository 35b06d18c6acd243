"""Filters and predicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_scope(df: DataFrame, **allowed: Sequence | None) -> DataFrame:
    """Rows whose columns have allowed values; None allows any."""
    tests = [F.col(c).isin(list(v)) for c, v in allowed.items() if v is not None]
    return df.where(reduce(and_, tests, F.lit(True)))


def conjunction_of_any(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Whether each group has a word that occurs in ``text``."""
    return reduce(and_, [reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in g], F.lit(False)) for g in groups], F.lit(True))


def only_one(values: DataFrame, full: Column, short: Column, value: str) -> DataFrame:
    """One row: the only value that meets ``full``, else the only one that meets ``short``, else null."""
    pick = lambda test: F.when(F.count_if(test) == 1, F.max(F.when(test, F.col(value))))
    return values.agg(F.coalesce(pick(full), pick(short)).alias(value))


def topic_memberships(df: DataFrame, name: Column, topics: Sequence[tuple[str, str]], *keep: str) -> DataFrame:
    """A row for each topic whose pattern the name matches."""
    labels = F.array_compact(F.array(*[F.when(name.rlike(p), F.lit(t)) for t, p in topics]))
    return df.select(*keep, F.explode(labels).alias("topic"))


def missing_topics(members: DataFrame, group: str, topics: Sequence[str]) -> DataFrame:
    """(group, topic) pairs that have no member."""
    every = members.select(group).distinct().select(group, F.explode(F.array(*[F.lit(t) for t in topics])).alias("topic"))
    return every.join(members, [group, "topic"], "left_anti")


def broken_rules(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """``df`` with reasons: names of all rules that a row breaks, and reason: the first."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))
    return df.withColumn("reasons", reasons).withColumn("reason", F.get("reasons", F.lit(0)))


def safe_url(url: Column) -> Column:
    """An http(s) URL without user info."""
    parts = [F.try_parse_url(url, F.lit(p)) for p in ("PROTOCOL", "HOST", "USERINFO")]
    return F.coalesce(F.lower(parts[0]).isin("http", "https") & parts[1].isNotNull() & parts[2].isNull(), F.lit(False))


def valid_excerpt(quote: Column, text: Column, limit: int) -> Column:
    """A quote is a contiguous part of the text and not longer than allowed."""
    return (F.length(quote) > 0) & F.contains(text, quote) & (F.length(quote) <= limit)
