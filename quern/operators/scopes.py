"""What a name stands for at a place: the last declaration of its kind that nothing has cleared since."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.scans import Scan, scanned


def in_force(df: DataFrame, key: Sequence[str], order: Sequence[str], kind: Column, declares: Column, clears: Column, name: str) -> DataFrame:
    """Adds ``name``: the last value declared for the row's ``kind`` before it in its key, unless a row between them clears all kinds.

    ``declares`` is the value that a row declares for its kind, null for none; ``clears``
    says which rows clear. A row that clears and declares does so in that order, and neither
    counts for itself. Null kinds are a kind of their own. Two scans over ranges: nothing
    is collected, and neither a key nor a kind is one task.
    """
    place = F.struct(*order)
    rows = scanned(df, key, order, quern_clear=Scan("last", F.when(clears, place), before=True))
    rows = rows.withColumn("quern_kind", kind)
    told = F.when(declares.isNotNull(), F.struct(place.alias("at"), declares.alias("value")))
    seen = scanned(rows, [*key, "quern_kind"], order, quern_told=Scan("last", told, before=True))
    valid = F.col("quern_clear").isNull() | (F.col("quern_told.at") >= F.col("quern_clear"))
    return seen.select(*df.columns, F.when(valid, F.col("quern_told.value")).alias(name))


def only_one_so_far(df: DataFrame, key: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the one value that the rows before this one in its key have, if all that have one agree; and ``<name>_n``: 0, 1 or 2 (more)."""
    seen = scanned(df, key, order, quern_low=Scan("min", value, before=True), quern_high=Scan("max", value, before=True))
    n = F.when(F.col("quern_low").isNull(), 0).when(F.col("quern_low") == F.col("quern_high"), 1).otherwise(2)
    return seen.select(*df.columns, F.when(n == 1, F.col("quern_low")).alias(name), n.alias(f"{name}_n"))
