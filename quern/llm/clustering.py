"""k-means in whole numbers with Elkan's bounds.

Vectors are turned into whole numbers, so distances, sums and centroids are exact and every
machine gives the same clusters. Each vector keeps its cluster, an upper bound of the
distance to its centroid and a lower bound for every centroid. When centroids move, bounds
move by as much. A centroid is skipped where its lower bound, or half its distance from the
vector's own centroid, lies over the upper bound; all other distances are calculated. Bounds
are rounded to the safe side and compared strictly, so a centroid at an equal distance is
never skipped and ties go to the smaller number, as without bounds.

A round reads the state of the one before and writes its own (vector, cluster, bounds);
Spark adds up the components of each cluster. The driver and the tasks hold k centroids.

Vectors of another length, or with a null, NaN or infinite component, are left out, and so
are those with a component of 2^27 or more in whole numbers, whose squared distances may
pass 64 bits. Equal vectors and repeated rows are rows like others. A null vec_id counts as
the empty string in the draw of the first centroids and stays null. With fewer vectors than
``k`` there are as many centroids as vectors. No vectors give no rows. Other columns are
left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.memory import lean
from quern.llm.store import drop_folder, finished, pick, written

#: Components in whole numbers stay below this.
LIMIT = 1 << 27
#: Floating-point results are moved by this share to the safe side, far more than they can be off.
SAFE = 2.0**-40
#: Vectors that are compared at once.
ROWS = 4096

STATE = "vec_id bigint, q array<int>, cluster int, upper float, lower array<float>, distance bigint"


def whole_numbers(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """(vec_id, q) of the vectors that are kept; q: floor(scale * component)."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT / scale)
    usable = F.coalesce(F.size("embedding") == size, F.lit(False)) & F.coalesce(F.forall("embedding", fine), F.lit(False))
    return vectors.where(usable).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("q"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of seed and id, in that order."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = kept.select("q", F.sha2(named, 256).alias("h")).orderBy("h", "q").limit(k).collect()
    return np.array([r["q"] for r in rows], np.int64)


def over(x: np.ndarray) -> np.ndarray:
    """float32 at or above ``x`` (not negative)."""
    return np.nextafter((x * (1 + SAFE)).astype(np.float32), np.float32(np.inf))


def under(x: np.ndarray) -> np.ndarray:
    """float32 at or below ``x``, 0 at least."""
    return np.maximum(np.nextafter((x * (1 - SAFE)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def between(centroids: np.ndarray) -> np.ndarray:
    """Half the distance of every two centroids, rounded down."""
    d = np.stack([squared(centroids, c) for c in centroids])
    return under(np.sqrt(d.astype(float)) / 2)


def assign(q: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector: cluster, upper bound, exact squared distance, and how many distances were calculated. ``lower`` is tightened in place."""
    cluster, upper = cluster.copy(), upper.copy()
    own, calculated = np.full(len(q), -1, np.int64), 0

    def measure(rows: np.ndarray) -> None:
        """The exact distance to the present centroid."""
        nonlocal calculated
        own[rows] = squared(q[rows], centroids[cluster[rows]])
        root = np.sqrt(own[rows].astype(float))
        upper[rows], lower[rows, cluster[rows]] = over(root), under(root)
        calculated += len(rows)

    for c in range(len(centroids)):
        open_ = lambda rows: rows[(cluster[rows] != c) & (lower[rows, c] <= upper[rows]) & (half[cluster[rows], c] <= upper[rows])]  # noqa: B023, E731
        rows = open_(np.arange(len(q)))
        measure(rows[own[rows] < 0])
        rows = open_(rows)
        if not len(rows):
            continue
        d = squared(q[rows], centroids[c])
        calculated += len(rows)
        root = np.sqrt(d.astype(float))
        lower[rows, c] = under(root)
        nearer = (d < own[rows]) | ((d == own[rows]) & (c < cluster[rows]))
        won = rows[nearer]
        cluster[won], own[won], upper[won] = c, d[nearer], over(root[nearer])
    measure(np.flatnonzero(own < 0))
    return cluster, upper, own, calculated


def matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def listed(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))


def assigned(state: DataFrame, centroids: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """State of the next round; ``moved``: how far each centroid has moved since the last (None: ``state`` has no bounds yet)."""
    k, width = centroids.shape
    half = between(centroids)
    moved_up = None if moved is None else over(np.sqrt(moved.astype(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                q = matrix(batch.column(1), np.int64, width)
                if moved_up is None:
                    cluster, upper, lower = np.zeros(len(q), np.int64), np.full(len(q), np.inf, np.float32), np.zeros((len(q), k), np.float32)
                else:
                    cluster = batch.column(2).to_numpy().astype(np.int64)
                    upper = over(batch.column(3).to_numpy().astype(float) + moved_up[cluster])
                    lower = under(np.maximum(matrix(batch.column(4), float, k) - moved_up, 0))
                cluster, upper, own, _ = assign(q, cluster, upper, lower, centroids, half)
                yield pa.RecordBatch.from_arrays([batch.column(0), listed(q.astype(np.int32)), pa.array(cluster.astype(np.int32)), pa.array(upper), listed(lower), pa.array(own)], ["vec_id", "q", "cluster", "upper", "lower", "distance"])

    return state.mapInArrow(lean(run), STATE)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster; an empty one stays where it is."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("q")[i].cast("long")) for i in range(centroids.shape[1])]).alias("s")).collect()  # k rows
    out = centroids.copy()
    for r in sums:
        out[r["cluster"]] = [s // r["n"] for s in r["s"]]
    return out


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """Each kept vector (vec_id, embedding) with its cluster after ``rounds`` rounds.

    Columns: vec_id, cluster (from 0), distance (squared, to its centroid), cluster_inertia
    and inertia (distances summed over the cluster and over all), centroid (its components).
    """
    return finished(vectors.sparkSession, "clusters", lambda: _clustered(pick(vectors, "vec_id", "embedding"), k, rounds, size, scale, seed))


def _clustered(vectors: DataFrame, k: int, rounds: int, size: int, scale: int, seed: int) -> DataFrame:
    spark = vectors.sparkSession
    state = written(whole_numbers(vectors, size, scale), "vectors")
    centroids, moved = first_centroids(state, k, seed), None
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    for last in [False] * rounds + [True]:
        before, state = state, written(assigned(state, centroids, moved), "state")
        drop_folder(before)
        if not last:
            after = means(state, centroids)
            centroids, moved = after, squared(after, centroids)
    sums = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    known = [(c, int(s), int(sum(sums.values())), centroids[c].tolist()) for c, s in sums.items()]
    each = spark.createDataFrame(known, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return state.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
