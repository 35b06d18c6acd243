"""Intermediate tables in the folder that driver and executors share.

They live as long as something may read them: until ``clear`` is called, or the driver's
process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Folders that this process has asked for.
_folders: set[str] = set()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under spark.checkpoint.dir (under /tmp in a local session without it) that nothing has used yet."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints"
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _folders.add(folder)
    return folder


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in a new folder and read back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(folder: str) -> None:
    jvm = SparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(jvm.org.apache.spark.deploy.SparkHadoopUtil.get().conf()).delete(path, True)
    _folders.discard(folder)


def dropped(df: DataFrame) -> None:
    """Delete the files behind a table that ``checkpointed`` made, when no later read needs them."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(folder)


def clear() -> None:
    """Delete every folder of this process; results that still read one are lost."""
    for folder in list(_folders):
        delete(folder)


@atexit.register
def _at_end() -> None:
    if SparkContext._jvm is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone by now
            clear()
