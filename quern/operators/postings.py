"""Inverted index in blocks: sorted arrays of integer ids, split by ranges of ids.

Rows are numbered once in their order and written by number. An id is a number's place in
its block of ``BLOCK`` numbers, so a posting is (gram, block, ids): a short sorted array,
which Parquet stores as bit-packed differences. A gram that every row has is one array a
block, never one row or task. A query is one pass over the postings of its own grams:
blocks meet by number, and in each the arrays are intersected, the rarest gram first, and
united where any of several words will do. Rows are then read by number.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.functions.query import Query
from quern.functions.text import grams

#: Numbers in a block.
BLOCK = 8192
#: So many candidates are read by their numbers, which skips pages and files; more are joined.
FEW_ROWS = 1000


@dataclass(frozen=True)
class Index:
    """An index in a folder: rows (n, ...), postings (gram, block, ids) and grams (gram, df: rows that have it)."""

    spark: SparkSession
    path: str
    row_schema: StructType

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.row_schema).parquet(f"{self.path}/rows")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema("gram string, block bigint, ids array<smallint>").parquet(f"{self.path}/postings")

    @property
    def grams(self) -> DataFrame:
        return self.spark.read.schema("gram string, df bigint").parquet(f"{self.path}/grams")


def build(rows: DataFrame, order: list[str], fields: list[Column], path: str) -> Index:
    """Number ``rows`` in ``order`` and index the grams of ``fields``; null fields have none."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id())
    # many small pages, so that a few rows are read alone
    ordered.write.option("parquet.page.row.count.limit", 200).parquet(f"{path}/rows")
    index = Index(spark, path, ordered.schema)
    every = F.array_distinct(F.flatten(F.array(*[F.coalesce(grams(f), F.array().cast("array<string>")) for f in fields])))
    n = F.col("n")
    held = index.rows.select(F.floor(n / BLOCK).alias("block"), (n % BLOCK).cast("smallint").alias("id"), F.explode(every).alias("gram"))
    blocks = held.groupBy("gram", "block").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # at most BLOCK ids
    # second version of the format: integers as bit-packed differences
    blocks.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.option("parquet.writer.version", "PARQUET_2_0").parquet(f"{path}/postings")
    index.postings.groupBy("gram").agg(F.sum(F.size("ids")).alias("df")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/grams")
    return index


def word_grams(word: str) -> list[str]:
    """What a row must hold to hold ``word``: its only character, or all its pairs."""
    return [word] if len(word) == 1 else list(dict.fromkeys(word[i : i + 2] for i in range(len(word) - 1)))


def asked_words(query: Query) -> list[list[list[str]]]:
    """For each term its alternatives, each a list of words that are all needed."""
    return [[[w] for w in dict.fromkeys((t.literal, t.value))] + ([t.parts] if t.parts else []) for t in query.terms]


def counts(index: Index, wanted: list[str]) -> dict[str, int]:
    """How many rows have each of a query's grams; 0 if none."""
    known = index.grams.where(F.col("gram").isin(wanted)).collect()  # as many rows as the query has grams
    return dict.fromkeys(wanted, 0) | {r["gram"]: r["df"] for r in known}


def candidates(index: Index, query: Query) -> DataFrame | None:
    """Numbers (n) of the rows that may match; None if the query has no terms."""
    terms = asked_words(query)
    wanted = sorted({g for t in terms for words in t for w in words for g in word_grams(w)})
    if not wanted:
        return None
    df = counts(index, wanted)
    possible = [[words for words in t if all(df[g] for w in words for g in word_grams(w))] for t in terms]
    if not all(possible):  # a term that no row can have
        return index.rows.select("n").limit(0)
    used = sorted({g for t in possible for words in t for w in words for g in word_grams(w)})
    at = {g: f"g{i}" for i, g in enumerate(used)}
    read = index.postings.where(F.col("gram").isin(used))
    blocks = read.groupBy("block").agg(*[F.max(F.when(F.col("gram") == g, F.col("ids"))).alias(c) for g, c in at.items()])  # one array a gram and block
    empty = F.array().cast("array<smallint>")

    def all_of(words: list[str]) -> Column:
        rarest = sorted({g for w in words for g in word_grams(w)}, key=lambda g: (df[g], g))
        return reduce(F.array_intersect, [F.coalesce(F.col(at[g]), empty) for g in rarest])

    found = reduce(F.array_intersect, [reduce(F.array_union, map(all_of, t)) for t in possible])
    return blocks.select(F.col("block"), F.explode(found).alias("id")).select((F.col("block") * BLOCK + F.col("id")).alias("n"))


def rows_of(index: Index, found: DataFrame | None) -> DataFrame:
    """The rows with these numbers; all for None. A few are read by number, so other pages stay unread."""
    if found is None:
        return index.rows
    few = [r["n"] for r in found.limit(FEW_ROWS + 1).collect()]
    if len(few) <= FEW_ROWS:
        return index.rows.where(F.col("n").isin(few)) if few else index.rows.limit(0)
    return index.rows.join(found, "n", "left_semi")
