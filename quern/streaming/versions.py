"""Change tracking on streams; the batch operators are in ``quern.operators.changes``."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def changed_versions(stream: DataFrame, key: str, order: str, digest: str) -> DataFrame:
    """Only the rows whose digest differs from the key's last one, with that one; the state is one digest a key."""
    fields = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = f"{key} {fields[key]}, {order} {fields[order]}, {digest} {fields[digest]}, previous {fields[digest]}"

    def track(_: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = []
        for k, at, d in rows[[key, order, digest]].itertuples(index=False):
            if d != last:
                out.append((k, at, d, last))
                last = d
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, order, digest, "previous"])

    return stream.groupBy(key).applyInPandasWithState(track, schema, f"last {fields[digest]}", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, at: str, column: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events of each kind in each window; rows later than ``late`` are not counted."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), column).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), column, "n")


def archive_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch in a folder of its own, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
