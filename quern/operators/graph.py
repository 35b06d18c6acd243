"""Graphs of documents: nodes, edges, descendants, scopes, places."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import hash_fraction
from quern.sinks.scratch import checkpointed

#: How far rulings lie from their laws, the outer ring of those without any, and how flat it is.
SPREAD, SPREAD_MORE, RING, RING_MORE, FLATTENED = 50, 185, 1000, 300, 0.8
#: Least extent of a space, its waves (height and length in x and y) and scatter of depth.
LEAST_EXTENT, WAVE, SCATTER = 200.0, (0.18, 5.2, 0.12, 5.8), 0.31
#: Margins for picking (laws, rulings, around a disc), and how much farther a ruling counts.
MARGINS, RULING_HANDICAP = (8.0, 4.0, 3.0), 0.18


def known_edges(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """Distinct edges between two known, different nodes."""
    ids = nodes.select(F.col(node).alias("from"))
    return edges.where(F.col("from") != F.col("to")).join(ids.withColumnRenamed("from", "to"), "to", "left_semi").join(ids, "from", "left_semi").select(*edges.columns).distinct()


def descendants(edges: DataFrame, roots: DataFrame, parent: str = "from", child: str = "to", root: str = "root") -> DataFrame:
    """All nodes reachable from each root, itself excluded: (root, node, depth), depth the shortest.

    Semi-naive: each round joins only nodes found in the round before, and none is found
    twice, so cycles end. Rounds are written to the shared folder, not recomputed.
    """
    e = edges.select(F.col(parent).alias("node"), F.col(child).alias("next")).distinct()
    start = roots.select(F.col(root).alias("root")).distinct()
    seen = checkpointed(start.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")), "seen")
    new, depth = seen, 0
    while True:
        depth += 1
        step = new.join(e, "node").select("root", F.col("next").alias("node")).distinct().join(seen.select("root", "node"), ["root", "node"], "left_anti")
        new = checkpointed(step.withColumn("depth", F.lit(depth)), "frontier")
        if new.isEmpty():
            return seen.where("depth > 0")
        seen = seen.unionByName(new)


def ancestors(edges: DataFrame, node) -> DataFrame:
    """Direct parents of a node."""
    return edges.where(F.col("to") == node).select(F.col("from").alias("node")).distinct()


def universe_edges(basis: DataFrame, references: DataFrame, citations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of three kinds between known nodes: from, to, kind.

    ``basis(parent, child)`` between laws, ``references(ruling, law)`` and
    ``citations(ruling, cited)``; of the last two each pair once and none from a ruling to itself.
    """
    law, ruling = (lambda c: F.concat(F.lit("l:"), c)), (lambda c: F.concat(F.lit("r:"), c))
    every = (
        basis.select(law(F.col("parent")).alias("from"), law(F.col("child")).alias("to"), F.lit("basis").alias("kind"))
        .unionByName(references.distinct().select(ruling(F.col("ruling")).alias("from"), law(F.col("law")).alias("to"), F.lit("reference").alias("kind")))
        .unionByName(citations.where("ruling <> cited").distinct().select(ruling(F.col("ruling")).alias("from"), ruling(F.col("cited")).alias("to"), F.lit("citation").alias("kind")))
    )
    ids = nodes.select(F.col("id").alias("from"))
    return every.join(ids, "from", "left_semi").join(ids.withColumnRenamed("from", "to"), "to", "left_semi").select("from", "to", "kind")


def edge_counts(edges: DataFrame) -> DataFrame:
    """How many edges there are of each kind."""
    return edges.groupBy("kind").agg(F.count("*").alias("n"))


def focus(edges: DataFrame, node: str) -> DataFrame:
    """What is shown with a node: a law with all its descendants, its parents and the rulings that refer to any of them; else its neighbours."""
    spark = edges.sparkSession
    own = spark.createDataFrame([(node,)], "node string")
    if not node.startswith("l:"):
        near = edges.where((F.col("from") == node) | (F.col("to") == node))
        return own.union(near.select("from")).union(near.select("to")).distinct()
    basis = edges.where("kind = 'basis'")
    family = own.union(descendants(basis, own.withColumnRenamed("node", "root")).select("node")).union(ancestors(basis, node)).distinct()
    rulings = edges.where("kind = 'reference'").join(family.withColumnRenamed("node", "to"), "to", "left_semi").select(F.col("from").alias("node"))
    return family.union(rulings).distinct()


def with_places(nodes: DataFrame, places: DataFrame, node: str = "id") -> DataFrame:
    """Nodes with their x, y and degree; 0 where none is known."""
    return nodes.join(places.select(node, "x", "y", "degree"), node, "left").na.fill(0, ["x", "y", "degree"])


def neighbourhood(edges: DataFrame, node) -> DataFrame:
    """Edges that begin or end at a node."""
    return edges.where((F.col("from") == node) | (F.col("to") == node))


def scoped(nodes: DataFrame, edges: DataFrame, scope) -> tuple[DataFrame, DataFrame]:
    """Nodes of a scope plus those that point into it, and the edges among them; pointing does not go on from there."""
    inside = nodes.where(scope)
    into = edges.join(inside.select(F.col("id").alias("to")), "to", "left_semi").select(F.col("from").alias("id"))
    ids = inside.select("id").union(into).distinct()
    kept = nodes.join(ids, "id", "left_semi")
    return kept, known_edges(kept, edges)


def placed_by_mean(refs: DataFrame, places: DataFrame, item: str, node: str) -> DataFrame:
    """Each item at the mean place of the nodes it refers to."""
    return refs.select(item, node).distinct().join(places, node).groupBy(item).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def placed_rulings(rulings: DataFrame, refs: DataFrame, places: DataFrame) -> DataFrame:
    """Rulings (id) near the mean place of the laws they refer to, or on an outer ring: id, x, y.

    Angle and distance depend on the id alone, so that rulings of one law don't lie on each other.
    """
    ident = F.col("id")
    angle, spread = 2 * math.pi * hash_fraction(ident), SPREAD + SPREAD_MORE * hash_fraction(F.concat(ident, F.lit("r")))
    ring = RING + RING_MORE * hash_fraction(F.concat(ident, F.lit("ring")))
    mean = placed_by_mean(refs.select(F.col("ruling").alias("id"), "law"), places.select("law", "x", "y"), "id", "law").toDF("id", "mx", "my")
    rows = rulings.select("id").join(mean, "id", "left")
    x = F.when(F.col("mx").isNotNull(), F.col("mx") + F.cos(angle) * spread).otherwise(F.cos(angle) * ring)
    y = F.when(F.col("my").isNotNull(), F.col("my") + F.sin(angle) * spread).otherwise(F.sin(angle) * ring * FLATTENED)
    return rows.select("id", x.alias("x"), y.alias("y"))


def in_space(nodes: DataFrame) -> DataFrame:
    """Nodes (id, x, y) about their middle, with a depth z for the eye alone and the extent of all."""
    box = nodes.agg(*[f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])  # one row
    rows = nodes.withColumn("quern_one", F.lit(1)).join(F.broadcast(box.withColumn("quern_one", F.lit(1))), "quern_one")
    extent = F.greatest(F.lit(LEAST_EXTENT), F.col("hix") - F.col("lox"), F.col("hiy") - F.col("loy"))
    x, y = F.col("x") - (F.col("lox") + F.col("hix")) / 2, F.col("y") - (F.col("loy") + F.col("hiy")) / 2
    placed = rows.select("id", x.alias("x"), y.alias("y"), extent.alias("extent"))
    wave = WAVE[0] * F.sin(F.col("x") / F.col("extent") * WAVE[1]) + WAVE[2] * F.cos(F.col("y") / F.col("extent") * WAVE[3])
    return placed.withColumn("z", F.col("extent") * (wave + (hash_fraction("id") - 0.5) * SCATTER))


def picked(points: DataFrame, x: float, y: float) -> DataFrame:
    """At most one row (id): the node at a place of the screen.

    ``points``: id, x, y, z, radius, kind, visible. The frontmost whose disc covers the
    place, then the nearest; else the one that is nearest for the size of its margin.
    """
    away = F.hypot(F.lit(x) - F.col("x"), F.lit(y) - F.col("y"))
    margin = F.greatest(F.when(F.col("kind") == "law", MARGINS[0]).otherwise(MARGINS[1]), F.col("radius") + MARGINS[2])
    near = points.where("visible").select("id", "z", "radius", "kind", away.alias("away"), margin.alias("margin")).where("away <= margin")
    covered = F.col("away") <= F.col("radius")
    score = F.col("away") / F.col("margin") + F.when(F.col("kind") == "ruling", RULING_HANDICAP).otherwise(0.0)
    return near.orderBy(~covered, F.when(covered, -F.col("z")), F.when(covered, F.col("away")).otherwise(score), F.desc("z")).limit(1).select("id")


def rotated(points: DataFrame, yaw: float, pitch: float, distance: float) -> DataFrame:
    """Points turned about two axes and projected: sx, sy, depth."""
    x1 = F.col("x") * F.cos(F.lit(yaw)) + F.col("z") * F.sin(F.lit(yaw))
    z1 = F.col("z") * F.cos(F.lit(yaw)) - F.col("x") * F.sin(F.lit(yaw))
    y2 = F.col("y") * F.cos(F.lit(pitch)) - z1 * F.sin(F.lit(pitch))
    z2 = z1 * F.cos(F.lit(pitch)) + F.col("y") * F.sin(F.lit(pitch))
    scale = distance / (distance + z2)
    return points.withColumn("sx", x1 * scale).withColumn("sy", y2 * scale).withColumn("depth", z2)


def bounds(points: DataFrame) -> DataFrame:
    return points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
