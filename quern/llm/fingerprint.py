"""Document fingerprints: every shingle hash below a fixed fraction of the hash space.

Sketches made at one fraction are mergeable (union) and give containment and likeness of
sets of very different size. A text whose shingles all lie above the fraction keeps its
smallest hash instead, so that only texts without words have an empty sketch. Such a
stand-in lies above the fraction, where other sketches hold nothing: containment in a
sketch of another kind can't be estimated from it and is null, and a union keeps a
stand-in only if no set in it has a hash below the fraction.

Only DataFrame functions run here. Null texts count as empty; texts of fewer than ``n``
words have one shingle, the whole sequence; texts without words have an empty
fingerprint, and two empty ones are alike (1.0). Rows that share a doc_id each get a
result; as a neighbour the smallest of their texts stands for them. A null doc_id sorts
below all others. One document alone is its own neighbour. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shingles import of, sequence_hash, shingle_hashes, words
from quern.llm.store import pick, written

#: One shingle hash in so many is kept.
SCALE = 8


def sketch_of(ws: Column, n: int, scale: int) -> Column:
    """Kept hashes of a word array, ascending."""
    every = F.when(F.size(ws) >= n, shingle_hashes(ws, n)).when(F.size(ws) > 0, F.array(sequence_hash(ws))).otherwise(F.array().cast("array<bigint>"))
    return F.array_sort(F.array_distinct(of(every, lambda e: kept(e, below(scale)))))


def below(scale: int) -> Column:
    """Hashes under this are kept."""
    return F.lit(-(2**63) + 2**64 // scale)


def kept(every: Column, limit: Column) -> Column:
    return of(F.filter(every, lambda h: h < limit), lambda k: F.when((F.size(k) > 0) | (F.size(every) == 0), k).otherwise(F.array(F.array_min(every))))


def sketched(df: DataFrame, text: str, out: str, n: int = 5, scale: int = SCALE) -> DataFrame:
    """``df`` with the sketch of column ``text`` as array<bigint> column ``out``."""
    return df.withColumn(out, of(words(F.col(text)), lambda w: sketch_of(w, n, scale)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the sets behind two sketches (of two stand-ins: whether they are the same)."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of the first set that lies in the second, however much larger that is.

    Null where the first sketch holds a stand-in that the second doesn't: then nothing of
    the first set is known that the second sketch would hold.
    """
    share = F.size(F.array_intersect(a, b)) / F.size(a)
    return F.when(F.size(a) == 0, F.lit(1.0)).when((F.array_min(a) >= below(scale)) & (share == 0), F.lit(None).cast("double")).otherwise(share)


def merged(sketches: Column, scale: int = SCALE) -> Column:
    """Sketch of the union of the sets behind an array of sketches."""
    return F.array_sort(kept(F.array_distinct(F.flatten(sketches)), below(scale)))


def as_text(sketch: Column) -> Column:
    """A sketch as one string: 16 hexadecimal digits a hash."""
    return F.concat_ws("", F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")))


def descending_neighbours(ids: DataFrame) -> DataFrame:
    """For each distinct doc_id of ``ids(doc_id, half)``: ``next_id``, the next lower one (for the lowest: the highest), and the largest half.

    Ids are sorted over range partitions; only one row a partition meets in one place.
    """
    ranged = ids.groupBy("doc_id").agg(F.max("half").alias("half")).repartitionByRange("doc_id")
    parts = written(ranged.select("doc_id", "half", F.spark_partition_id().alias("part")), "ids")
    own = Window.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"))
    inner = parts.select("*", F.lead("doc_id").over(own).alias("lower"), F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"))).alias("rn"))
    tops = parts.groupBy("part").agg(F.max("doc_id").alias("top"))
    around = Window.orderBy("part")  # one row a partition
    below = tops.select("part", F.coalesce(F.lag("part").over(around), F.max("part").over(Window.partitionBy())).alias("below"))
    tops = tops.select(F.col("part").alias("below"), "top")
    edges = below.join(tops, "below").select("part", "top")
    return inner.join(edges, "part").select("doc_id", "half", F.when(F.col("rn") == 1, F.col("top")).otherwise(F.col("lower")).alias("next_id"))


def edited_pairs(docs: DataFrame, n: int = 5, scale: int = SCALE) -> DataFrame:
    """doc_id, text, sketch, edited (text), edited_sketch and next_sketch of every row.

    The edited text has the last half of the code points replaced by the first as many
    (or all) of the next document's, in descending order of doc_id.
    """
    base = sketched(pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))), "text", "sketch", n, scale)
    half = F.floor(F.length("text") / 2).cast("int")
    ids = pick(docs, "doc_id", "text").select("doc_id", F.coalesce(half, F.lit(0)).alias("half"))
    links = written(descending_neighbours(ids), "neighbours")

    donors = base
    if ids.count() > links.count():  # some ids are repeated
        donors = base.groupBy("doc_id").agg(F.min(F.struct("text", "sketch")).alias("least")).select("doc_id", "least.*")
    heads = donors.join(links.select(F.col("doc_id").alias("receiver"), "next_id", "half"), F.col("doc_id").eqNullSafe(F.col("next_id"))).select(
        "receiver", F.expr("left(text, half)").alias("head"), F.col("sketch").alias("next_sketch")
    )
    paired = base.join(heads, F.col("doc_id").eqNullSafe(F.col("receiver"))).select(
        "doc_id", "text", "sketch", "next_sketch", F.expr("concat(left(text, length(text) - cast(floor(length(text) / 2) as int)), left(head, cast(floor(length(text) / 2) as int)))").alias("edited")
    )
    return sketched(paired, "edited", "edited_sketch", n, scale)
