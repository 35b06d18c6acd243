"""The corpus pipeline: quality, near duplicates, benchmark items, secrets, packing.

Each stage works on all rows that the one before it kept. The first four return the
columns of ``documents``, whatever other columns there are and however alike their names
(``text`` and ``TEXT``); the last returns the packed pieces. Null ids and ids of several
rows are allowed everywhere; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, near_dedup, packing, quality, secrets
from quern.llm.labelled import fold, sampled
from quern.llm.queries import MAX_CHARS, PER_LABEL, TOKENIZER
from quern.llm.store import by_place, drop_folder, finished, written

#: Documents that score below this are rejected.
LEAST_QUALITY = 0.3
#: Rows of one batch between Spark and Python: texts are long, and a batch is held on both sides.
BATCHES, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2500


@contextmanager
def bounded(spark: SparkSession) -> Iterator[None]:
    """Small batches between Spark and Python for the work inside; the session's own setting holds again afterwards."""
    before = spark.conf.get(BATCHES)
    spark.conf.set(BATCHES, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(BATCHES, before)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the compression classifier doesn't reject.

    Null and empty texts score the share of good labels, so they stay where good labels are
    not rare. Repeated rows and texts score alike, each for itself; a text of any length is
    read whole. Labels with fewer than two texts of one class (an empty table too) fit no
    classifier; it then rejects none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(sampled(docs, labels, "quality", fold(F.col("doc_id"), 5) != 0, PER_LABEL, MAX_CHARS))
    if not model.weights:
        return docs
    plain, text = by_place(docs, "text")
    return quality.scored(plain, model, text, "score").where(F.col("score") >= LEAST_QUALITY).drop("score").toDF(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by five-word shingles at 0.8 or more.

    It is one with the smallest id (null is the largest); rows that repeat id and text are
    one. Null, empty and blank texts are in no group and stay.
    """
    with bounded(spark):
        return near_dedup.one_of_each(docs, n=5, threshold=0.8)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove documents that hold a benchmark item, whatever its id; each row is judged by its own text.

    Null, empty and blank texts hold nothing; such items, and an empty benchmark, are found nowhere.
    """
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every row stays, null and empty texts as they are. ``n_chars``, if there is one, is counted anew."""
    return secrets.redact(docs)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into training sequences; null and empty texts have the end id alone, repeated rows are packed each."""
    with bounded(spark):
        return packing.packed(docs, public_tokenizers.path(TOKENIZER), end_id=1)


STAGES = [
    ("quality classifier", good_quality),
    ("near duplicates", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("secret scan", without_secrets),
    ("packing", into_sequences),
]

#: Compression, sketches and tokens can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces, written once; the stages' tables and all others on the way are deleted."""
    with bounded(spark):
        return finished(spark, "pipeline", lambda: _run(spark, sf_dir))


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    *filters, last = STAGES
    for name, stage in filters:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop_folder(before)
        before = docs
    return last[1](spark, docs, sf_dir)
