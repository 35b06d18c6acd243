"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

Items are partitioned by the size of their shingle set (powers of two). In a partition
whose largest set has u shingles, an item's sketch keeps its u - ceil(t*u) + 1 smallest
shingle hashes. A document that holds at least the share t of an item's shingles must hold
one of these, so the search misses nothing; its candidates are verified on full sets.

Only DataFrame functions run here. Words are lower-cased and separated by white space.
Null, empty and blank texts hold nothing and are found nowhere. An item of fewer than
``n`` words counts as one shingle of that many words. Repeated rows of documents or items
share their id and give one result row; a null doc_id or item_id is a key like any other. Empty tables give an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shingles import of, shingle_hashes, words
from quern.llm.store import if_small, pick, written

#: Sketch entries up to which the items' index is sent to all executors (16 bytes each); beyond it, Spark's joins shuffle.
BROADCAST_ENTRIES = 1_000_000
#: Documents (their keys of at most 64 bytes) up to which they are sent to all executors, so that no text is shuffled.
BROADCAST_KEYS = 200_000


def item_sets(items: DataFrame, n: int) -> DataFrame:
    """item_id, gram (its shingle length) and set (distinct shingle hashes, ascending)."""
    ws = pick(items, "item_id", "text").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    gram = F.least(F.size("w"), F.lit(n))
    chosen: Column = shingle_hashes(F.col("w"), n)
    for g in range(1, n):
        chosen = F.when(gram == g, shingle_hashes(F.col("w"), g)).otherwise(chosen)
    return ws.select("item_id", gram.alias("gram"), F.array_sort(F.array_distinct(chosen)).alias("set"))


def enough(shared: Column, size: Column, threshold: float) -> Column:
    """Whether ``shared`` of ``size`` reach the threshold; the little less makes up for how 0.8 and the like are stored."""
    return shared >= size * F.lit(threshold) - F.lit(1e-9)


def sketch_size(threshold: float) -> Column:
    """Hashes to keep for the largest set of an item's size partition."""
    upper = F.pow(2, F.floor(F.log2(F.size("set"))) + 1) - 1
    return (upper - F.ceil(upper * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")


def document_sets(docs: DataFrame, grams: list[int]) -> DataFrame:
    """Shingle hashes of every document, repeats included, for each shingle length that items have."""
    return docs.select("doc_id", of(words(F.col("text")), lambda w: F.concat(*[shingle_hashes(w, g) for g in grams])).alias("all"))


def contaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row for each document and item of which it holds at least ``threshold`` of the shingles.

    Columns: doc_id, item_id, item_shingles (long), shared (long), containment (double).
    """
    docs = pick(docs, "doc_id", "text")
    sets = written(item_sets(items, n), "items")
    grams = [r["gram"] for r in sets.select("gram").distinct().collect()] or [n]  # at most n values

    sketch = if_small(sets.select("item_id", F.explode(F.slice("set", F.lit(1), sketch_size(threshold))).alias("h")), BROADCAST_ENTRIES)
    probes = document_sets(docs, grams).select("doc_id", F.explode_outer("all").alias("h"))
    candidates = written(probes.join(sketch, "h").select("doc_id", "item_id").distinct(), "candidates")

    ids = if_small(candidates.select(F.col("doc_id").alias("id")).distinct(), BROADCAST_KEYS)
    found = document_sets(docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi"), grams)
    full = found.select("doc_id", F.array_distinct("all").alias("all")).join(if_small(candidates.toDF("id", "item"), BROADCAST_KEYS), F.col("doc_id").eqNullSafe(F.col("id"))).join(sets, F.col("item_id").eqNullSafe(F.col("item")))
    shared = full.select("doc_id", "item_id", F.size("set").cast("long").alias("item_shingles"), F.size(F.array_intersect("set", "all")).cast("long").alias("shared"))
    return (
        shared.where(enough(F.col("shared"), F.col("item_shingles"), threshold))
        .groupBy("doc_id", "item_id")
        .agg(F.max("item_shingles").alias("item_shingles"), F.max("shared").alias("shared"))
        .withColumn("containment", F.col("shared") / F.col("item_shingles"))
    )


def without_contaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; columns unchanged.

    Decided by the text (its SHA-256), whatever the ids: rows with a null or shared id
    stand each for itself.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key = F.sha2(F.col(f"c{docs.columns.index('text')}"), 256)
    texts = pick(docs, "text").select(F.sha2("text", 256).alias("doc_id"), "text")
    bad = written(contaminated(texts, items, n, threshold).select(F.col("doc_id").alias("quern_key")).distinct(), "contaminated")
    bad = if_small(bad, BROADCAST_KEYS)
    return plain.withColumn("quern_key", key).join(bad, "quern_key", "left_anti").drop("quern_key").toDF(*docs.columns)
