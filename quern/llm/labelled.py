"""Bounded samples of labelled texts for fitting small models on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.store import pick

#: So many times the wanted rows of a label are ordered by hash to take the first of them.
MARGIN = 1.25


@dataclass
class Sample:
    """Texts and labels, and how many rows of each label there are to learn from."""

    texts: list[str]
    labels: list
    counts: dict


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id's decimal text, modulo ``k``."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % k).cast("int")


def hash_bound(wanted: int, rows: int) -> int:
    """A 64-bit hash at or below which ``MARGIN`` times the wanted of so many rows are expected; the largest if all are wanted."""
    share = MARGIN * (wanted + 100) / max(1, rows)
    return 2**63 - 1 if share >= 1 else int(share * 2**64) - 2**63


def sampled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_label: int, max_chars: int) -> Sample:
    """At most ``per_label`` documents of each value of ``label``, in the order of a hash of their id.

    ``labels`` has doc_id and the label column; ``learn`` says which of its rows may be
    used. Rows without an id or a label are left out, and so are texts that are null or
    longer than ``max_chars``, which bounds what the driver holds.
    """
    known = pick(labels, "doc_id", label).withColumnRenamed(label, "label").where(learn & F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    # hashes under a bound that about MARGIN times as many rows pass as are wanted: few rows meet in a label's window
    bound = F.coalesce(*[F.when(F.col("label") == k, F.lit(hash_bound(per_label, n))) for k, n in counts.items()], F.lit(2**63 - 1))
    order = Window.partitionBy("label").orderBy("hash", "doc_id")
    near = known.withColumn("hash", F.xxhash64("doc_id")).where(F.col("hash") <= bound)
    chosen = near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_label).select("doc_id", "label")  # at most per_label rows a label
    texts = pick(docs, "doc_id", "text").where(F.length("text") <= max_chars).join(F.broadcast(chosen), "doc_id")
    rows = sorted(texts.select("doc_id", "text", "label").collect())
    return Sample([r["text"] for r in rows], [r["label"] for r in rows], counts)
