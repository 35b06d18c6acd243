"""Sharding by histogram sort: probe, count exact bytes below, refine, exchange once.

Rows are ordered by (hash of the text, doc_id), so equal texts lie side by side and a
hot group of copies can still be cut. Each round counts the bytes and rows below a set
of probe keys in every partition and narrows the interval that holds each wanted cut;
it ends when the bytes below a cut are within tolerance or no row lies between. Only the
cuts between shards are sought on the driver, however large the data; the one exchange
then splits shards into ranges of about ``run_bytes``, so that no task sorts a whole
shard, and slots go on from the rows of the ranges before.

A null text counts no bytes besides the row's fixed cost, and a null doc_id sorts first.
Rows equal in text and doc_id stay together. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.store import drop_folder, if_small, pick, written

LOW, HIGH = -(2**63), 2**63 - 1
#: Bytes that a row costs besides its text.
ROW_BYTES = 8
#: Probes of one round at most.
PROBES = 65536
#: Spark's row ids number the rows of a partition in so many bits; the partition's number stands above.
ID_BITS = 33
#: Ranges up to which their rows are sent to all executors (20 bytes each).
BROADCAST_RANGES = 200_000


def below_index(h: np.ndarray, d: np.ndarray, ph: np.ndarray, pd_: np.ndarray) -> np.ndarray:
    """How many of the sorted probes (ph, pd_) are at or below each key (h, d)."""
    left, right = np.searchsorted(ph, h, "left"), np.searchsorted(ph, h, "right")
    for value in np.unique(h[left < right]):
        at = np.flatnonzero(h == value)
        lo, hi = left[at[0]], right[at[0]]
        left[at] = lo + np.searchsorted(pd_[lo:hi], d[at], "right")
    return left


def _count(batches: Iterator[pa.RecordBatch], ph: np.ndarray, pd_: np.ndarray) -> Iterator[pa.RecordBatch]:
    size, rows = np.zeros(len(ph) + 1, np.int64), np.zeros(len(ph) + 1, np.int64)
    for b in batches:
        at = below_index(b.column("h").to_numpy(), b.column("d").to_numpy(), ph, pd_)
        np.add.at(size, at, b.column("size").to_numpy())
        rows += np.bincount(at, minlength=len(rows))
    some = np.flatnonzero(rows)
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (some, size[some], rows[some])], names=["bin", "size", "n"])


def histogram(keys: DataFrame, ph: np.ndarray, pd_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each probe; at most one row a probe comes to the driver."""
    part = keys.mapInArrow(functools.partial(_count, ph=ph, pd_=pd_), "bin long, size long, n long")
    size, rows = np.zeros(len(ph) + 1, np.int64), np.zeros(len(ph) + 1, np.int64)
    for r in part.groupBy("bin").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect():
        size[r["bin"]], rows[r["bin"]] = r["size"], r["n"]
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


@dataclass
class Cut:
    """A wanted cut: the keys (hash, doc_id) around it and the bytes and rows below each."""

    target: float
    slack: float
    lo: tuple[int, int]
    hi: tuple[int, int]
    lo_bytes: int
    hi_bytes: int
    lo_rows: int
    hi_rows: int
    key: tuple[int, int] | None = None

    def probes(self, n: int) -> list[tuple[int, int]]:
        if self.lo[0] + 1 < self.hi[0]:  # between hashes
            step = max(1, (self.hi[0] - self.lo[0]) // (n + 1))
            return [(h, LOW) for h in range(self.lo[0] + step, self.hi[0], step)][:n]
        top = self.hi[1] if self.hi[0] == self.lo[0] else HIGH  # within one hash
        step = max(1, (top - self.lo[1]) // (n + 1))
        return [(self.lo[0], d) for d in range(self.lo[1] + step, top, step)][:n] or [(self.lo[0], top)]

    def narrow(self, keys: list[tuple[int, int]], size: np.ndarray, rows: np.ndarray) -> None:
        """Close in on the target with the bytes and rows below sorted probe keys."""
        first, last = bisect_right(keys, self.lo), bisect_left(keys, self.hi)
        over = first + int(np.searchsorted(size[first:last], self.target, "right"))
        if over > first:
            self.lo, self.lo_bytes, self.lo_rows = keys[over - 1], int(size[over - 1]), int(rows[over - 1])
        if over < last:
            self.hi, self.hi_bytes, self.hi_rows = keys[over], int(size[over]), int(rows[over])
        near_lo = self.target - self.lo_bytes <= self.hi_bytes - self.target
        miss = self.target - self.lo_bytes if near_lo else self.hi_bytes - self.target
        same = self.lo[0] == self.hi[0] and self.lo[1] + 1 >= self.hi[1] or self.hi == (self.lo[0] + 1, LOW) and self.lo[1] == HIGH
        if miss <= self.slack or self.hi_rows - self.lo_rows <= 1 or same:
            self.key = self.lo if near_lo else self.hi


def cuts(keys: DataFrame, targets: list[tuple[float, float]], total: int, rows: int) -> list[tuple[int, int]]:
    """Keys at which the bytes below come nearest to each (target, slack)."""
    found = [Cut(t, s, (LOW, LOW), (HIGH, HIGH), 0, total, 0, rows) for t, s in targets]
    while todo := [c for c in found if c.key is None]:
        probes = sorted({p for c in todo for p in c.probes(max(1, min(63, PROBES // len(todo))))})
        size, n = histogram(keys, np.array([p[0] for p in probes]), np.array([p[1] for p in probes]))
        for c in todo:
            c.narrow(probes, size, n)
    return sorted(c.key for c in found)


def sharded(docs: DataFrame, shards: int = 24, run_bytes: int = 64 << 20, tolerance: float = 0.001) -> DataFrame:
    """``docs`` (doc_id, text and all other columns) dealt to ``shards`` ranges of near equal bytes.

    Returned: doc_id, text, size (long), shard (int) and slot (long, gapless from 0 in a
    shard, in key order).
    """
    rows = pick(docs, "doc_id", "text").select(
        "doc_id", "text", F.xxhash64("text").alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("d"), (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size")
    )
    keys = written(rows.select("h", "d", "size"), "keys")
    total, n = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    share = total / shards
    edges = cuts(keys, [(share * i, share * tolerance) for i in range(1, shards)], total, n) if n else []
    drop_folder(keys)
    ph, pd_ = np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64)

    @F.pandas_udf("int")
    def shard_of(h: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(below_index(h.to_numpy(), d.to_numpy(), ph, pd_))

    # one exchange: ranges of the key inside shards, each of about run_bytes; a row's number in its range is in its id
    order = ["shard", "h", "d", "text"]
    ranges = rows.withColumn("shard", shard_of("h", "d")).repartitionByRange(max(shards, -(-total // run_bytes)), "shard", "h", "d").sortWithinPartitions(*order)
    placed = written(ranges.select("doc_id", "text", "size", "shard", F.monotonically_increasing_id().alias("id")), "ranges")
    placed = placed.withColumn("part", F.shiftright("id", ID_BITS)).withColumn("at", F.col("id") % (1 << ID_BITS))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = counts.select("shard", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))
    found = placed.join(if_small(written(bases, "bases"), BROADCAST_RANGES), ["shard", "part"])
    return found.select("doc_id", "text", "size", "shard", (F.col("base") + F.col("at")).cast("long").alias("slot"))
