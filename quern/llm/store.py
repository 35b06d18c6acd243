"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sinks.scratch import delete, new_folder

#: Folder of the block of work that goes on (see ``finished``).
_block: ContextVar[str | None] = ContextVar("block", default=None)


def new_table(spark: SparkSession, name: str) -> str:
    return f"{_block.get()}/{name}-{uuid.uuid4().hex}" if _block.get() else new_folder(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts the lineage, survives lost executors."""
    path = new_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(df: DataFrame) -> None:
    """Delete the files behind a table that ``written`` made, when no later read needs them."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(folder)


def finished(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, written once; every table that is written on the way lies in one folder, which is deleted then.

    Inside another piece of work the result is one of its tables, and goes with them.
    """
    folder, out = new_folder(spark, f"{name}-work"), new_table(spark, name)
    token = _block.set(folder)
    try:
        result = make()
        result.write.parquet(out)
        schema = result.schema
    finally:
        _block.reset(token)
        delete(folder)
    return spark.read.schema(schema).parquet(out)


def if_small(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, marked to be sent to all executors if they are counted to be few."""
    return F.broadcast(rows) if rows.count() <= most else rows


def by_place(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` with columns named by place, so that names that differ in case only can't clash, and the new name of column ``name``."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), f"c{df.columns.index(name)}"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name, so extra columns (even ones that differ in case only) can't clash."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select([F.col(f"c{df.columns.index(n)}").alias(n) for n in names])
