"""Snapshots: differences, reconciliation, loss guards, archives, saved evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def difference(old: DataFrame, new: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Keys that were added, removed or changed: key, change, old and new value."""
    a, b = old.select(*key, F.col(value).alias("old"), F.lit(True).alias("in_old")), new.select(*key, F.col(value).alias("new"), F.lit(True).alias("in_new"))
    both = a.join(b, list(key), "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("change", change).where("change is not null").select(*key, "change", "old", "new")


def reconciled(previous: DataFrame, candidates: DataFrame, failures: DataFrame, key: str, value: str) -> DataFrame:
    """Status of each key over three sources.

    A valid candidate updates or confirms; a failed one keeps what was there; what was
    never tried is retained; without anything to keep it is unavailable. Kept: the value
    that holds from now on.
    """
    p = previous.select(key, F.col(value).alias("before"))
    c = candidates.select(key, F.col(value).alias("candidate"))
    f = failures.select(key, F.lit(True).alias("failed")).distinct()
    rows = p.join(c, key, "full_outer").join(f, key, "full_outer")
    status = (
        F.when(F.col("candidate").isNotNull() & F.col("failed").isNull(), F.when(F.col("candidate").eqNullSafe(F.col("before")), "unchanged").otherwise("updated"))
        .when(F.col("before").isNull(), "unavailable")
        .when(F.col("failed"), "retained")
        .otherwise("not-attempted")
    )
    return rows.withColumn("status", status).select(key, "status", F.when(F.col("status") == "updated", F.col("candidate")).otherwise(F.col("before")).alias("kept"))


def losses(old: DataFrame, new: DataFrame, key: str, size: str, least: int = 5, share: float = 0.8) -> DataFrame:
    """Keys that are gone, or had ``least`` parts and kept fewer than ``share`` of them."""
    both = old.select(key, F.col(size).alias("before")).join(new.select(key, F.col(size).alias("after")), key, "left")
    reason = F.when(F.col("after").isNull(), "missing").when((F.col("before") >= least) & (F.col("after") < F.col("before") * share), "shrunk")
    return both.withColumn("reason", reason).where("reason is not null").select(key, "before", "after", "reason")


def to_append(archive: DataFrame, batch: DataFrame, key: str, order: str, digest: str) -> DataFrame:
    """Rows of ``batch`` whose digest differs from the last one archived for their key."""
    last = archive.groupBy(key).agg(F.max_by(digest, order).alias("quern_last"))
    return batch.join(last, key, "left").where(~F.col(digest).eqNullSafe(F.col("quern_last"))).withColumnRenamed("quern_last", "previous_digest")


def violations(rows: DataFrame, refs: DataFrame, key: str, ref: str) -> DataFrame:
    """References to keys that do not exist."""
    return refs.join(rows.select(F.col(key).alias(ref)), ref, "left_anti")


def watch_states(baseline: DataFrame, current: DataFrame, key: str, digest: str, source: str) -> DataFrame:
    """What became of each watched item: missing, changed, source-changed or unchanged."""
    now = current.select(key, F.col(digest).alias("now"), F.col(source).alias("source_now"))
    state = F.when(F.col("now").isNull(), "missing").when(~F.col(digest).eqNullSafe(F.col("now")), "changed").when(~F.col(source).eqNullSafe(F.col("source_now")), "source-changed").otherwise("unchanged")
    return baseline.join(now, key, "left").withColumn("state", state)


def merged_entries(mine: DataFrame, theirs: DataFrame, key: str, identity: Sequence[str]) -> DataFrame:
    """Mine and theirs: identical ones once, same key with other content under a new key."""
    alike = theirs.join(mine.select(key, *identity), [key, *identity], "left_anti")
    clash = alike.join(mine.select(key).distinct().withColumn("quern_clash", F.lit(True)), key, "left")
    renamed = clash.withColumn(key, F.when(F.col("quern_clash"), F.concat(F.col(key).cast("string"), F.lit("-copy"))).otherwise(F.col(key).cast("string"))).drop("quern_clash")
    return mine.withColumn(key, F.col(key).cast("string")).unionByName(renamed)


def distinct_evidence(entries: DataFrame, identity: Sequence[str], order: str) -> DataFrame:
    """First entry of each identity; entries meet by its digest, as it may hold whole texts."""
    w = Window.partitionBy(F.sha2(F.to_json(F.struct(*identity), {"ignoreNullFields": "false"}), 256)).orderBy(order)
    return entries.withColumn("quern_rn", F.row_number().over(w)).where("quern_rn = 1").drop("quern_rn")


def left_over(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` without as many equal ones of ``b``."""
    return a.exceptAll(b)


def evidence_rows(*pairs: tuple[str, Column]) -> Column:
    """Label and value of each given column as an array of structs, those without value left out."""
    rows = F.array(*[F.struct(F.lit(k).alias("label"), v.cast("string").alias("value")) for k, v in pairs])
    return F.filter(rows, lambda r: F.coalesce(r["value"], F.lit("")) != "")
