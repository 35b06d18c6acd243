"""Writers: tables whose rows have content hashes, version archives, manifests, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import html_escape
from quern.operators.changes import to_append


def with_hash(df: DataFrame, *columns: str, name: str = "content_hash") -> DataFrame:
    """Adds the SHA-256 of the columns, in the order of their names, nulls included."""
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256))


def write_shards(df: DataFrame, path: str, partition_by: Sequence[str], rows_per_file: int = 1_000_000) -> None:
    """Parquet in a folder for each partition value; large partitions are split over several tasks and files."""
    df.hint("rebalance", *partition_by).write.option("maxRecordsPerFile", rows_per_file).partitionBy(*partition_by).mode("overwrite").parquet(path)


def write_index(postings: DataFrame, path: str) -> None:
    """Postings by kind and region, grams together, so that a lookup reads few row groups."""
    postings.repartitionByRange("kind", "region", "gram").sortWithinPartitions("kind", "region", "gram").write.partitionBy("kind", "region").mode("overwrite").parquet(path)


def append_versions(archive: DataFrame | None, batch: DataFrame, path: str, key: str = "law", order: str = "recorded_at", digest: str = "content_hash") -> None:
    """Append the versions whose hash differs from the last one archived; running twice adds nothing."""
    new = batch.withColumn("previous_digest", F.lit(None).cast("string")) if archive is None else to_append(archive, batch, key, order, digest)
    new.write.mode("append").parquet(path)


def manifest(files: DataFrame) -> DataFrame:
    """Each distinct file once: url, bytes."""
    return files.groupBy("url").agg(F.max("bytes").alias("bytes"))


def packs(files: DataFrame, group: str) -> DataFrame:
    """Per group: number of distinct files and their bytes together."""
    return files.dropDuplicates([group, "url"]).groupBy(group).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def unused_files(files: DataFrame, kept: DataFrame) -> DataFrame:
    """Files that no kept pack needs."""
    return files.select("url").distinct().join(kept.select("url"), "url", "left_anti")


def write_by(df: DataFrame, path: str, key: str) -> None:
    """A table that is looked up by one key: a folder for each value."""
    df.hint("rebalance", key).write.partitionBy(key).mode("overwrite").parquet(path)


def read_by(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """Rows of one key of a table that ``write_by`` wrote; other folders are not read, and none is an empty result."""
    return spark.read.parquet(path).where(F.col(key) == value)


def from_buckets(records: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Records (with bucket) that are asked for by id; both sides have the bucket, so that only its folders are read."""
    wanted = ids.select(key, range_bucket(F.col(key).cast("long")).alias("bucket"))
    return records.join(wanted, [key, "bucket"], "left_semi")


def write_runtime(path: str, **named: DataFrame) -> DataFrame:
    """Small tables that a reader loads first (catalogue, citation targets, context) under one path, and what was written: name, n."""
    spark, out = None, None
    for name, df in named.items():
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        one = spark.read.schema(df.schema).parquet(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def range_bucket(number: Column, size: int = 256) -> Column:
    """Bucket of a numeric id, by which point lookups read one folder."""
    return F.floor(number / size).cast("long")


def markdown(entries: DataFrame) -> DataFrame:
    """One Markdown document a folder, entries in order."""
    line = F.concat(F.lit("## "), "title", F.lit("\n\n> "), F.replace(F.col("quote"), F.lit("\n"), F.lit("\n> ")), F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("\n\n"), F.col("note"))).otherwise(""))
    parts = entries.groupBy("folder_id", "folder").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("lines"))
    return parts.select("folder_id", F.concat(F.lit("# "), "folder", F.lit("\n\n"), F.array_join(F.transform("lines", lambda s: s["line"]), "\n\n")).alias("markdown"))


def casebook_html(entries: DataFrame) -> DataFrame:
    """One HTML page a folder, every text escaped."""
    e = html_escape
    part = F.concat(F.lit("<section><h2>"), e(F.col("title")), F.lit("</h2><blockquote>"), e(F.col("quote")), F.lit("</blockquote>"), F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("<p>"), e(F.col("note")), F.lit("</p>"))).otherwise(""), F.lit("</section>"))
    parts = entries.groupBy("folder_id", "folder").agg(F.array_sort(F.collect_list(F.struct("ord", part.alias("part")))).alias("parts"))
    body = F.array_join(F.transform("parts", lambda s: s["part"]), "")
    return parts.select("folder_id", F.concat(F.lit('<!doctype html><meta charset="utf-8"><title>'), e(F.col("folder")), F.lit("</title><h1>"), e(F.col("folder")), F.lit("</h1>"), body).alias("html"))


def casebook_json(entries: DataFrame) -> DataFrame:
    """One JSON object a folder."""
    e = F.struct("ord", "id", "title", "quote", "contentHash", "note")
    folders = entries.groupBy("folder_id", "folder").agg(F.array_sort(F.collect_list(e)).alias("entries"))
    return folders.select("folder_id", F.to_json(F.struct(F.col("folder_id").alias("id"), F.col("folder").alias("name"), "entries")).alias("json"))
