"""Nearest target of many points by descent through a tree of cells.

Targets lie in cells of a grid whose sides are four times as long from level to level; a
cell knows the box around its targets. All points begin with the few cells of the highest
level and go down together: each cell that a point still looks at gives way to those in it,
and a cell goes when even the nearest place of its box is farther than the farthest place of
some other box, which holds a target. What is left at the lowest level are places, so the
answer is exact, and a point looks at a handful of cells a level, not at all targets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sinks.scratch import checkpointed

#: Cells of one level in a row of the next.
SIDE_BITS = 2
#: Cells of the highest level that every point begins with, at most.
ROOTS = 16


def _cell(value: Column, level: int) -> Column:
    return F.shiftright(value, SIDE_BITS * level)


def _gap(p: Column, lo: Column, hi: Column) -> Column:
    """How far ``p`` lies outside lo..hi."""
    return F.greatest(lo - p, p - hi, F.lit(0))


def nearest(points: DataFrame, targets: DataFrame, ids: Sequence[str], target: str, tie: Sequence[Column]) -> DataFrame:
    """Each point (``ids``, x, y) with its nearest of ``targets`` (x, y, ``target``, ...): ids, ``target``, distance (squared).

    x and y are whole numbers below 2^30 in size, so distances are exact. Among targets at
    one distance the first by ``tie`` (expressions over the columns of ``targets``), then
    the smallest ``target``. Points with a null place, and all points if there are no
    targets, are left out; ``ids`` tell points apart.
    """
    names = [f"quern_t{i}" for i in range(len(tie))]
    ranked = F.struct(*[t.alias(n) for t, n in zip(tie, names, strict=True)], F.col(target))
    whole = lambda c: F.col(c).cast("long")
    places = checkpointed(targets.where("x is not null and y is not null").groupBy(whole("x").alias("tx"), whole("y").alias("ty")).agg(F.min(ranked).alias("best")), "places")
    box = places.agg(F.min("tx"), F.max("tx"), F.min("ty"), F.max("ty")).first()
    if box[0] is None:
        return points.select(*ids, F.lit(None).cast(targets.schema[target].dataType).alias(target), F.lit(None).cast("long").alias("distance")).limit(0)
    top = 0
    while ((box[1] >> SIDE_BITS * top) - (box[0] >> SIDE_BITS * top) + 1) * ((box[3] >> SIDE_BITS * top) - (box[2] >> SIDE_BITS * top) + 1) > ROOTS:
        top += 1
    asked = points.where("x is not null and y is not null").select(*ids, whole("x").alias("px"), whole("y").alias("py"))
    roots = [(x, y) for x in range(box[0] >> SIDE_BITS * top, (box[1] >> SIDE_BITS * top) + 1) for y in range(box[2] >> SIDE_BITS * top, (box[3] >> SIDE_BITS * top) + 1)]
    rows = asked.withColumn("cell", F.explode(F.array(*[F.struct(F.lit(x).cast("long").alias("cx"), F.lit(y).cast("long").alias("cy")) for x, y in roots]))).select(*ids, "px", "py", "cell.*")
    own = Window.partitionBy(*ids)
    # the roots hold too much for their boxes to tell, so the first step goes below them
    for level in range(top - 1, -1, -1):
        cells = places.groupBy(_cell(F.col("tx"), level).alias("nx"), _cell(F.col("ty"), level).alias("ny")).agg(F.min("tx").alias("x0"), F.max("tx").alias("x1"), F.min("ty").alias("y0"), F.max("ty").alias("y1"))
        cells = cells.withColumns({"cx": F.shiftright("nx", SIDE_BITS), "cy": F.shiftright("ny", SIDE_BITS)})
        x, y = F.col("px"), F.col("py")
        least = F.pow(_gap(x, F.col("x0"), F.col("x1")), F.lit(2)) + F.pow(_gap(y, F.col("y0"), F.col("y1")), F.lit(2))
        most = F.pow(F.greatest(F.abs(x - F.col("x0")), F.abs(x - F.col("x1"))), F.lit(2)) + F.pow(F.greatest(F.abs(y - F.col("y0")), F.abs(y - F.col("y1"))), F.lit(2))
        inner = rows.join(cells, ["cx", "cy"]).withColumn("bound", F.min(most).over(own)).where(least <= F.col("bound"))
        rows = inner.select(*ids, "px", "py", F.col("nx").alias("cx"), F.col("ny").alias("cy"))
    if top == 0:  # all places lie in the roots
        rows = rows.dropDuplicates([*ids, "cx", "cy"])
    met = rows.join(places, (F.col("cx") == F.col("tx")) & (F.col("cy") == F.col("ty")))
    distance = (F.col("px") - F.col("tx")) * (F.col("px") - F.col("tx")) + (F.col("py") - F.col("ty")) * (F.col("py") - F.col("ty"))
    return met.groupBy(*ids).agg(F.min(F.struct(distance.alias("distance"), "best")).alias("m")).select(*ids, F.col(f"m.best.{target}").alias(target), "m.distance")
