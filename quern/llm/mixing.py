"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source has a target number of words. Blocks of equal size are dealt to sources by the
highest quotients ``target / (2j - 1)``, and each source's blocks to its shards likewise by
their words, so every quota is a whole number. In a shard, documents in the order of a
seeded hash make one stream of words that is cut into blocks. A quota takes whole passes of
the stream first; what is left takes blocks in the order of another seeded hash, the last of
them in part. So no word is taken more often than ``MOST`` times, a source misses its target
by about a block, and a rerun takes the same words.

Only DataFrame functions run here; texts are read once and never shuffled. Shards hold
about ``SHARD_WORDS`` words whatever their source holds, so a source with a third of all
rows is many shards, and a task sorts a few of them. Tables with one row a source, or one
a shard, are all that a single task ever ranks.

Null texts count as empty: size 0, nothing taken. Rows with a null source are a source of
their own, the last. Null doc_ids and rows that repeat id and text are rows like others; of
equal rows it is not said which of them a cut block falls on. A source without words has
target 0. An empty table gives none. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.store import finished, if_small, pick, written

#: Weights of the sources in order, over and over; the mix has SHARE[0] / SHARE[1] of all words; a source gives at most MOST times its own.
WEIGHTS, SHARE, MOST = (5, 2, 1), (3, 2), 2
#: Words of a block: one of BLOCKS of all words, BLOCK_WORDS at most.
BLOCK_WORDS, BLOCKS = 64, 65_536
#: A source has a shard for each so many words.
SHARD_WORDS = 1 << 20
#: So many sources may be sent to all executors.
FEW_SOURCES = 100_000

WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size (words of the text), key (by which documents are put in order)."""
    text = F.coalesce("text", F.lit(""))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(named).alias("key"))


def targets(sources: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int) -> DataFrame:
    """``sources(source, source_size)``, one row each, with place (from 0, null last), target and all (words of all sources).

    Sources in the order of ``most * size / weight``: one is full if its own share of what
    the full ones before it leave would be more than it may give; the others share the rest.
    """
    everything = Window.partitionBy()
    by_name, by_ratio = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy("ratio", "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    cycle = F.array(*map(F.lit, weights))
    rows = sources.withColumn("place", (F.row_number().over(by_name) - 1).cast("long"))
    rows = rows.withColumn("weight", F.get(cycle, (F.col("place") % len(weights)).cast("int"))).withColumn("cap", F.col("source_size") * most)
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("all", F.sum("source_size").over(everything))
    given = F.coalesce(F.sum("cap").over(before), F.lit(0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("level", (F.col("all") * share[0] / share[1] - given) / left).withColumn("full", F.col("ratio") <= F.col("level"))
    level = F.min(F.when(~F.col("full"), F.struct("ratio", "place", "level"))).over(everything)["level"]
    return rows.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * level)).select("source", "source_size", "place", "target", "all")


def apportioned(rows: DataFrame, group: Sequence[str], weight: str, seats: str, order: str) -> DataFrame:
    """Adds quota: the seats of a group dealt to its rows by Sainte-Laguë; equal quotients go to the first in ``order``.

    A divisor a little too large gives each row seats that it has for certain, one a little
    too small all that it may have. Only the quotients between them are ranked, about two a
    row, and not as many as there are seats. Rows without weight get none.
    """
    whole = Window.partitionBy(*group)
    total, n = F.sum(weight).over(whole).cast("double"), F.count("*").over(whole)
    part = F.when(F.col(weight) > 0, F.col(weight).cast("double") / F.nullif(total, F.lit(0.0)))  # null: no weight
    sure = F.greatest(F.floor(part * (F.col(seats) - n / 2) + 0.5) - 1, F.lit(0))
    most = F.floor(part * (F.col(seats) + n / 2) + 0.5) + 1
    known = rows.withColumn("sure", F.coalesce(sure, F.lit(0)).cast("long")).withColumn("most", F.coalesce(most, F.lit(0)).cast("long"))
    known = known.withColumn("open", F.col(seats) - F.sum("sure").over(whole))
    each = known.withColumn("j", F.explode_outer(F.when(F.col("most") > F.col("sure"), F.sequence(F.col("sure") + 1, F.col("most")))))
    quotient = F.col(weight) / (2 * F.col("j") - 1)
    best = Window.partitionBy(*group).orderBy(F.desc_nulls_last(quotient), order, "j")
    won = F.count_if(F.col("j").isNotNull() & (F.col("at") <= F.col("open")))
    return each.withColumn("at", F.row_number().over(best)).groupBy(*rows.columns).agg((F.first("sure") + won).alias("quota"))


def dealt_sources(rows: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int) -> DataFrame:
    """One row a source: targets, block (words of one) and quota (its blocks)."""
    known = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("all") / BLOCKS))).cast("long")
    seats = F.floor((2 * share[0] * F.col("all") + share[1] * F.col("block")) / (2 * share[1] * F.col("block"))).cast("long")
    return apportioned(known.withColumn("block", block).withColumn("seats", seats), [], "target", "seats", "place")


def shard_of(key: Column, source_size: Column, words: int) -> Column:
    """Which of its source's shards a document is in; a shard for each ``words`` words."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % (F.floor(source_size / words) + 1)


def blocks(cells: DataFrame, seed: int, most: int) -> DataFrame:
    """The blocks of each shard's stream: at (first word), passes (of the whole stream), extra (first words of the block taken once more), rest (extra words of the shard)."""
    words = F.least(F.col("quota") * F.col("block"), F.col("cell") * most)
    rows = cells.where("cell > 0").select("place", "shard", "cell", "block", F.floor(words / F.col("cell")).cast("long").alias("passes"), (words % F.col("cell")).alias("rest"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("cell") - 1) / F.col("block")))))
    at = F.col("k") * F.col("block")
    named = F.concat_ws(":", F.lit(f"{seed}"), "place", "shard", "k")
    rows = rows.withColumn("at", at).withColumn("length", F.least(F.col("block"), F.col("cell") - at)).withColumn("key", F.md5(named))
    before = Window.partitionBy("place", "shard").orderBy("key", "k").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.coalesce(F.sum("length").over(before), F.lit(0))
    return rows.select("place", "shard", "at", "passes", "rest", F.greatest(F.lit(0), F.least(F.col("length"), left)).cast("long").alias("extra"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST, seed: int = 11, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Each document with the words that the mix takes of it.

    Columns: doc_id, size, source_size, target (of its source), taken (repeats counted),
    source, shard (of its source), start (its first word in the shard's stream), copies
    (whole passes over it; ``taken - copies * size`` words of it are taken once more).
    """
    return finished(docs.sparkSession, "mixture", lambda: _mixed(pick(docs, "doc_id", "text", "source"), weights, share, most, seed, shard_words))


def _mixed(docs: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int, seed: int, shard_words: int) -> DataFrame:
    rows = written(sizes(docs, seed), "sizes")
    sources = written(dealt_sources(rows, weights, share, most), "sources").withColumnRenamed("source", "of")
    placed = rows.join(if_small(sources, FEW_SOURCES), F.col("source").eqNullSafe(F.col("of"))).withColumn("shard", shard_of(F.col("key"), F.col("source_size"), shard_words))
    cells = placed.groupBy("place", "shard").agg(F.sum("size").alias("cell"), F.first("quota").alias("seats"), F.first("block").alias("block"))
    cuts = blocks(apportioned(cells, ["place"], "cell", "seats", "shard"), seed, most)

    stream = Window.partitionBy("place", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(stream), F.lit(0))
    texts = placed.select("place", "shard", "doc_id", "source", "size", "source_size", "target", start.alias("at"), F.lit(1).alias("side"))
    both = texts.unionByName(cuts.withColumn("side", F.lit(0)), allowMissingColumns=True)
    # a document begins in the last block that begins at or before it; empty ones come before the one that begins with them
    order = Window.partitionBy("place", "shard").orderBy("at", "side", "size", "doc_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    block = F.last(F.when(F.col("side") == 0, F.struct("at", "extra", "passes", "rest")), ignorenulls=True).over(so_far)
    known = both.withColumn("in", block).withColumn("sum", F.sum("extra").over(so_far)).where("side = 1")
    inside = F.col("sum") - F.col("in.extra") + F.least(F.col("at") - F.col("in.at"), F.col("in.extra"))
    known = known.withColumn("taken_before", inside)
    extra = F.coalesce(F.lead("taken_before").over(order), F.col("in.rest")) - F.col("taken_before")
    taken = F.coalesce(F.col("in.passes") * F.col("size") + extra, F.lit(0))
    return known.withColumn("taken", taken).select("doc_id", "size", "source_size", "target", "taken", "source", "shard", F.col("at").alias("start"), F.coalesce("in.passes", F.lit(0)).alias("copies"))
