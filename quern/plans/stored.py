"""Queries over tables that are written and read again: lookups, buckets, indexes, checks of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.query import compile_query
from quern.functions.text import grams
from quern.operators import evidence, search
from quern.plans.registry import query, table
from quern.sinks import tables
from quern.sinks.scratch import new_folder


@query("SELECT doc_id, lang FROM documents WHERE source = 'src3'")
def looked_up_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """A table written by key, one key read."""
    path = new_folder(spark, "lookup")
    tables.write_by(table(spark, sf, "documents").select("doc_id", "lang", "source"), path, "source")
    return tables.read_by(spark, path, "source", "src3").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def records_from_buckets(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "buckets")
    docs = table(spark, sf, "documents").select("doc_id", "lang", tables.range_bucket(F.col("doc_id")).alias("bucket"))
    tables.write_shards(docs, path, ["bucket"])
    kept = spark.read.schema("doc_id long, lang string, bucket long").parquet(path)
    return tables.from_buckets(kept, table(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id").select("doc_id", "lang")


@query("""SELECT coalesce(lang, 'none') AS region, count(*) AS n FROM (SELECT DISTINCT doc_id, lang, unnest(list_concat(string_split(lower(text), ''), list_transform(range(1, length(text)), lambda i: substr(lower(text), i, 2)))) AS gram FROM documents WHERE text <> '') GROUP BY 1""")
def index_by_region(spark: SparkSession, sf: str) -> DataFrame:
    """An index written by kind and region; the counts of its parts."""
    docs = table(spark, sf, "documents")
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("none")).alias("region"), F.lit("laws").alias("kind"), F.explode(grams(F.lower("text"))).alias("gram"))
    path = new_folder(spark, "regions")
    tables.write_index(rows, path)
    return spark.read.parquet(path).groupBy("region").agg(F.count("*").alias("n"))


@query("SELECT doc_id, true AS complete, CAST(length(t) - length(regexp_replace(substr(text, 1, length(text) // 3), '[\\s\\x0b]+', '', 'g')) - length(regexp_replace(substr(text, length(text) // 2, length(text) // 4), '[\\s\\x0b]+', '', 'g')) AS INT) AS outside FROM (SELECT *, regexp_replace(text, '[\\s\\x0b]+', '', 'g') AS t FROM documents)")
def parts_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Two parts of each text are found in it again, in order, and the rest is counted."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cut = F.array(F.struct(F.lit(0).alias("ord"), F.expr("substr(text, 1, length(text) div 3)").alias("part")), F.struct(F.lit(1).alias("ord"), F.expr("substr(text, cast(length(text) div 2 as int), cast(length(text) div 4 as int))").alias("part")))
    parts = docs.select("doc_id", F.explode(cut).alias("p")).select("doc_id", "p.*")
    return evidence.in_order(docs, parts, "doc_id", "text", "part", "ord")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CAST(100 * CAST(contains(lower(substr(text, 1, 60)), 'the') AND contains(lower(substr(text, 1, 60)), 'bad') AS INT) + 20 AS INT) AS score FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'bad')")
def letter_search(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as letters, their first sixty characters as titles."""
    empty = [F.lit("").alias(c) for c in ("number_norm", "number_key", "topic_norm", "unit_norm")]
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("ord"), F.lower(F.substr("text", F.lit(1), F.lit(60))).alias("title_norm"), F.lower("text").alias("body_norm"), *empty, F.array().cast("array<struct<law:string,article_norm:string,evidence_norm:string>>").alias("refs"))
    return search.search_rulings(rows, compile_query("the bad")).select("id", "score")
