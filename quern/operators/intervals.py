"""Joins of points with spans without a key, and chains of disjoint spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.scans import Scan, scanned
from quern.sinks.scratch import checkpointed, dropped


def _levels(length: Column, width: int) -> Column:
    """The least level whose bins (``width`` times a power of two) a span of this length touches at most two of."""
    ratio = F.greatest(F.ceil(length / width), F.lit(1))
    return F.ceil(F.log2(ratio.cast("double"))).cast("int")


def binned_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int, key: Sequence[str] = (), most: int = 62) -> DataFrame:
    """Every point with each span that holds it (start <= at < end), by equi-joins on bins.

    Bins of ``width`` double from level to level. A span lies in the one or two bins of the
    level that fits its length, so it is copied twice at most, however long it is. A point
    asks its bin of every level that some span has (counted first: a few dozen at most).
    A pair meets in exactly one bin, the one of the point. Positions are whole numbers;
    spans that are empty or have a null end hold nothing, nor does a null point lie in any.
    Equal bins of many spans are split by AQE like any join key. ``key`` columns must be
    equal too. Spans' columns follow the points'.
    """
    usable = spans.where(F.col(start) < F.col(end)).withColumn("quern_level", F.least(_levels(F.col(end) - F.col(start), width), F.lit(most)))
    levels = sorted(r[0] for r in usable.select("quern_level").distinct().collect())  # a few dozen at most
    if not levels:
        levels = [0]
    bins = F.call_function("shiftleft", F.lit(width).cast("long"), F.col("quern_level"))
    in_bins = F.sequence(F.floor(F.col(start) / bins), F.floor((F.col(end) - 1) / bins))
    held = usable.withColumn("quern_bin", F.explode(in_bins))
    asked = points.where(F.col(at).isNotNull()).withColumn("quern_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("quern_bin", F.floor(F.col(at) / bins))
    p, s = asked.alias("p"), held.alias("s")
    on = (F.col("p.quern_level") == F.col("s.quern_level")) & (F.col("p.quern_bin") == F.col("s.quern_bin"))
    for k in key:
        on = on & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    on = on & (F.col(f"p.{at}") >= F.col(f"s.{start}")) & (F.col(f"p.{at}") < F.col(f"s.{end}"))
    return p.join(s, on).select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"s.{c}") for c in spans.columns if c not in key])


def overlapping(left: DataFrame, right: DataFrame, start: str, end: str, width: int, tell: str = "_b") -> DataFrame:
    """Pairs of spans that share a place, each once: the later start of the two lies in the other span.

    Columns of ``right`` get the suffix ``tell``.
    """
    other = right.toDF(*[f"{c}{tell}" for c in right.columns])
    s, e = f"{start}{tell}", f"{end}{tell}"
    inside = binned_join(left.where(F.col(start) < F.col(end)), other, start, s, e, width)  # left begins inside right, or with it
    around = binned_join(other.where(F.col(s) < F.col(e)), left, s, start, end, width).where(F.col(s) > F.col(start))
    return inside.unionByName(around.select(*inside.columns))


def counted_inside(points: DataFrame, spans: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Each distinct point with how many spans hold it: running sums of begun and ended spans, no pairs.

    One line of any length: the sums are scanned over ranges.
    """
    ok = spans.where(F.col(start) < F.col(end))
    edges = ok.select(F.col(start).alias("quern_at"), F.lit(1).alias("quern_step")).unionByName(ok.select(F.col(end).alias("quern_at"), F.lit(-1).alias("quern_step")))
    steps = edges.groupBy("quern_at").agg(F.sum("quern_step").alias("quern_step")).withColumn("quern_point", F.lit(False))
    asked = points.select(F.col(at).alias("quern_at")).where(F.col(at).isNotNull()).distinct().select("quern_at", F.lit(0).cast("long").alias("quern_step"), F.lit(True).alias("quern_point"))
    seen = scanned(steps.unionByName(asked), [], ["quern_at", "quern_point"], held=Scan("sum", F.col("quern_step")))
    return seen.where("quern_point").select(F.col("quern_at").alias(at), F.col("held"))


def disjoint_chain(spans: DataFrame, key: Sequence[str], start: str, end: str, *more: str) -> DataFrame:
    """From the first span of a key on, each that begins at or after the end of the last one kept.

    Spans are met in the order of (start, end, ``more``), which should tell those of a key
    apart. Each points to the first after it that begins at or after its end; pointers are
    doubled, and what the first span of its key reaches is kept. Pointers come from a scan
    over ranges, so a key of any length is many tasks, and rounds grow with the logarithm
    of the longest chain. Spans with an end before their start, or a null, are left out.
    Positions are whole numbers.
    """
    order = [start, end, *more]
    rows = spans.where(F.col(start) <= F.col(end))
    numbered = checkpointed(scanned(rows, [], [*key, *order], quern_n=Scan("sum", F.lit(1).cast("long"))), "numbered")
    n, none = F.col("quern_n"), F.lit(None).cast("long")
    empty = F.col(start) == F.col(end)
    # backwards along the line: at a span's end, the least number of those that begin from there on
    ends = numbered.select(*key, (-F.col(end)).alias("quern_at"), F.when(empty, -n).otherwise(0).alias("quern_m"), F.lit(0).alias("quern_side"), n, none.alias("quern_to"))
    begins = numbered.select(*key, (-F.col(start)).alias("quern_at"), (-n).alias("quern_m"), F.lit(1).alias("quern_side"), n, n.alias("quern_to"))
    jumps = scanned(ends.unionByName(begins), key, ["quern_at", "quern_m", "quern_side", "quern_n"], quern_next=Scan("min", F.col("quern_to")))
    links = checkpointed(jumps.where("quern_side = 0 and quern_next is not null").select("quern_n", F.col("quern_next").alias("quern_to")), "links")
    reached = checkpointed(numbered.groupBy(*key).agg(F.min("quern_n").alias("quern_n")).select("quern_n"), "reached")
    count = reached.count()
    while True:
        further = reached.join(links, "quern_n").select(F.col("quern_to").alias("quern_n"))
        after = checkpointed(reached.unionByName(further).distinct(), "reached")
        dropped(reached)
        reached, before = after, count
        count = reached.count()
        if count == before:
            break
        far = links.select(F.col("quern_n").alias("quern_to"), F.col("quern_to").alias("quern_far"))
        doubled = checkpointed(links.join(far, "quern_to").select("quern_n", F.col("quern_far").alias("quern_to")), "links")
        dropped(links)
        links = doubled
    return numbered.join(reached, "quern_n").select(*spans.columns)
