"""Near duplicates: bottom-k sketches, inverted lists of kept hashes, union-sketch filter, exact Jaccard.

1. A document's set holds the hashes of its distinct word shingles (lower-cased A-Z,
   words separated by ASCII white space; fewer words than a shingle: the whole sequence
   is one). Documents with equal sets become one node, so copies are never paired.
2. A node's sketch is its k smallest hashes. Two sets of similarity t share at least m of
   them, up to a chance of ``MISS``. Hashes that one node alone keeps are dropped, then a
   node's rarest ones are its entries in the inverted lists: all but m - 1 of those left.
   Two nodes that share m must meet in a list, and frequent passages stay out of the
   lists of documents that have enough else.
3. Lists of up to ``SHORT`` nodes give all their pairs. In a longer list each node is
   compared with one pivot, the node whose hashes are most common; what stays outside
   the list's main component then meets other members of it for some rounds. What is in one component
   needs no more links, and Jaccard distance is a metric: what lies close to the main
   pivot (t) can link only to what is not too far from it (2t - 1). The pairs that remain
   are compared on full sets, block by block inside tasks, which give just the links that
   join components.
4. Other pairs pass if their union sketch does not rule out t; links are confirmed on full sets.

Null and empty texts and texts without words have empty sets and no links. A null doc_id
is never the smallest of a component; a component of nothing but nulls has a null id.
Rows that share a doc_id each get a row. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.components import connected_components
from quern.llm.memory import lean, release
from quern.llm.store import by_place, finished, if_small, pick, written

K = 64
#: Chance that a pair at the threshold shares fewer sketch entries than asked for.
MISS = 1e-9
#: Lists up to this length give all their pairs.
SHORT = 8
#: Members of a longer list's main component that others meet in one round, and the most rounds.
PIVOTS, ROUNDS = 16, 2
#: A list takes part in further rounds if one member in so many is in its main component; others are left to the blocks.
GROUP = 10
#: About so many nodes of a longer list are compared in one call with as many others.
BLOCK = 512
#: The part of a cluster whose members are compared with one another.
WITHIN = 2
#: Rows to drop up to which they are sent to all executors (about 50 bytes each); beyond it Spark's join shuffles.
BROADCAST_ROWS = 200_000
#: Pairs of whole sets in one batch after which a worker gives back memory.
MANY = 1000
#: Words whose hash a worker keeps before it starts anew.
CACHED = 100_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shared_at_least(k: int, share: float) -> int:
    """Least m with P(Binomial(k, share) < m) above ``MISS``: fewer than m in common is as good as impossible at that similarity."""
    total = 0.0
    for m in range(k + 1):
        total += math.comb(k, m) * share**m * (1 - share) ** (k - m)
        if total > MISS:
            return m
    return k


class Shingler:
    """Sets of shingle hashes of texts; keeps the hashes of words it has met."""

    def __init__(self, n: int) -> None:
        self.n, self.cache = n, {}

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ascending distinct uint64 hashes of each text's shingles."""
        split = [(t or "").encode().translate(_LOWER).split() for t in texts]
        if len(self.cache) > CACHED:
            self.cache.clear()
        for w in set().union(*split).difference(self.cache):
            self.cache[w] = xxhash.xxh3_64_intdigest(w)
        get, n, out = self.cache.__getitem__, self.n, []
        for ws in split:
            h = np.fromiter(map(get, ws), np.uint64, len(ws))
            if len(ws) < n:
                out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), 1)] if ws else [], np.uint64))
                continue
            s = np.full(h.size - n + 1, n, np.uint64)
            for j in range(n):
                s = s * _STEP + h[j : h.size - n + 1 + j]
            s = (s ^ (s >> np.uint64(29))) * _MIX
            out.append(np.unique(s ^ (s >> np.uint64(32))))
        return out


def reaches(both, union, threshold: float):
    """Whether a similarity reaches the threshold; the little more makes up for how 0.8 and the like are stored."""
    return both + 1e-6 >= threshold * union


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


@lean
def _sketch(batches: Iterator[pa.RecordBatch], n: int, k: int) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(n)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            sets = shingler.sets(part.column("text").to_pylist())
            columns = [part.column("doc_id"), pa.array([s.size for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s[:k].view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "key", "sketch"])


@lean
def _full(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(n)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            sets = shingler.sets(batch.column("text").slice(lo, 256).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "set"])


def in_union_sketch(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int]:
    """Entries that both ascending sketches have among the k smallest of their union, and the number of those."""
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    last = np.cumsum(np.append(True, ~twice))  # distinct values so far
    size = min(k, int(last[-1])) if both.size else 0
    return int((twice & (last[1:] <= k)).sum()), size


def candidates_of(size: int, common: int, k: int, share: float) -> bool:
    """Whether ``common`` of ``size`` union-sketch entries leaves similarity ``share`` possible."""
    return common >= (shared_at_least(k, share) if size == k else math.ceil(round(share * size, 9)))


def union_filter(pairs: DataFrame, nodes: DataFrame, k: int, threshold: float) -> DataFrame:
    """``pairs(a, b)`` with far: similarity under 2t - 1 is certain, and near: t is possible."""
    s = nodes.select("node", "sketch")
    rows = pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b")

    @F.pandas_udf("near boolean, far boolean")
    def judge(sa: pd.Series, sb: pd.Series) -> pd.DataFrame:
        near, far = np.zeros(len(sa), bool), np.zeros(len(sa), bool)
        for i, (x, y) in enumerate(zip(sa, sb, strict=True)):
            common, size = in_union_sketch(x.view(np.uint64), y.view(np.uint64), k)
            near[i] = candidates_of(size, common, k, threshold)
            far[i] = not candidates_of(size, common, k, max(0.0, 2 * threshold - 1))
        return pd.DataFrame({"near": near, "far": far})

    return rows.select("a", "b", judge("sa", "sb").alias("j")).select("a", "b", "j.near", "j.far")


def full_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(node, set): the whole sets of the ``wanted`` nodes, made again from the texts of documents that hold them."""
    known = written(wanted.select("node").distinct().join(nodes.select("node", "key", "rep"), "node"), "wanted")
    reps = if_small(written(known.select("rep").distinct(), "reps"), BROADCAST_ROWS)
    texts = docs.join(reps, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    sets = texts.mapInArrow(functools.partial(_full, n=n), "key binary, set binary").dropDuplicates(["key"])
    return written(sets.join(known.select("node", "key"), "key").select("node", "set"), "sets")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """The ``pairs(a, b)`` whose full sets have the similarity."""
    pairs = written(pairs, "pairs")
    sets = full_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), nodes, docs, n)

    @F.pandas_udf("boolean")
    def alike(sa: pd.Series, sb: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(sa, sb, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.intersect1d(x, y, assume_unique=True).size
            out.append(reaches(both, x.size + y.size - both, threshold))
        if len(out) >= MANY:
            release()
        return pd.Series(out, dtype=bool)

    rows = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return rows.where(alike("sa", "sb")).select("a", "b")


def inverted_lists(nodes: DataFrame, k: int, threshold: float) -> DataFrame:
    """(value, node, weight): the entries of each node; weight says how common its hashes are."""
    every = nodes.select("node", "n_shingles", F.explode("sketch").alias("value"))
    often = every.groupBy("value").agg(F.count("*").alias("freq")).where("freq > 1")
    whole = math.floor(threshold * k)  # up to here no partner has a set beyond k
    needed = F.when(F.col("n_shingles") <= whole, F.ceil(F.round(F.col("n_shingles") * threshold, 6))).otherwise(F.lit(shared_at_least(k, threshold))).cast("int")
    per_node = every.join(often, "value").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("freq", "value"))).alias("e"), F.first(needed).alias("m"))  # at most k
    entries = per_node.where(F.size("e") >= F.col("m")).select("node", F.slice("e", F.lit(1), F.size("e") - F.col("m") + 1).alias("e"), F.aggregate("e", F.lit(0.0), lambda s, x: s + F.log(x["freq"].cast("double"))).alias("weight"))
    return entries.select("node", "weight", F.explode("e.value").alias("value"))


def common(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """How many values each pair of sets shares; values are taken ``columns`` at a time."""
    sizes = [len(x) for x in (*left, *right)]
    values, codes, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.cumsum(times > 1) - 1  # a value that one set alone has is in no intersection
    keep = times[codes] > 1
    owner, codes = owner[keep], place[codes[keep]]
    order = np.argsort(codes, kind="stable")
    owner, codes = owner[order], codes[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(codes[-1]) + 1 if codes.size else 0, columns):
        at = slice(*np.searchsorted(codes, [lo, lo + columns]))
        dense = np.zeros((len(sizes), columns), np.float32)
        dense[owner[at], codes[at] - lo] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def _blocks(key, pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between the two sides of a block pair: of those that join different components, enough to join them.

    A block against itself comes as one side only.
    """
    sides = [pdf[pdf["side"] == side] for side in (0, 1)]
    if key[2] == key[3] and key[1] == WITHIN:
        sides[1] = sides[0]
    if sides[0].empty or sides[1].empty:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    left, right = ([np.frombuffer(s, np.uint64) for s in x["set"]] for x in sides)
    both = common(left, right)
    size = [np.array([len(s) for s in x], np.float64) for x in (left, right)]
    i, j = np.nonzero(reaches(both, size[0][:, None] + size[1][None] - both, threshold))
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (to := up.get(x, x)) != x:
            up[x] = up.get(to, to)
            x = to
        return x

    nodes, comps = ([x[c].to_numpy() for x in sides] for c in ("node", "comp"))
    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = root(int(comps[0][x])), root(int(comps[1][y]))
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((int(nodes[0][x]), int(nodes[1][y])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def block_links(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between the sides 0 and 1 of each part of ``members(main, part, side, node, comp)``, of any length.

    Part ``WITHIN`` has side 0 alone, whose members are compared with one another, each pair once.
    """
    blocks = lambda side: F.ceil(F.count_if(F.col("side") == side) / BLOCK).cast("int")
    within = F.col("part") == WITHIN
    count = members.groupBy("main", "part").agg(blocks(0).alias("b0"), blocks(1).alias("b1")).withColumn("b1", F.when(within, F.col("b0")).otherwise(F.col("b1"))).where("b0 > 0 and b1 > 0")
    mine = F.col("side") == 0
    own, other = F.when(mine, F.col("b0")).otherwise(F.col("b1")), F.when(mine, F.col("b1")).otherwise(F.col("b0"))
    placed = members.join(count, ["main", "part"]).withColumn("own", F.pmod(F.xxhash64("node"), own).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
    first = (within & (F.col("own") <= F.col("other"))) | (~within & mine)  # whose row of blocks it is
    pair = [F.when(first, F.col("own")).otherwise(F.col("other")).alias("i"), F.when(first, F.col("other")).otherwise(F.col("own")).alias("j")]
    rows = placed.select("main", "part", F.when(first, 0).otherwise(1).alias("side"), "node", "comp", *pair)
    return rows.join(sets, "node").groupBy("main", "part", "i", "j").applyInPandas(functools.partial(_blocks, threshold=threshold), "a long, b long")


def with_components(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows(node, ...)`` with comp: the least node linked with it so far."""
    return rows.join(links.toDF("node", "least"), "node", "left").withColumn("comp", F.coalesce("least", "node")).drop("least")


def pivots(rows: DataFrame, order: Column) -> DataFrame:
    """(value, pivots): the first ``PIVOTS`` nodes of each list in the given order."""
    top = rows.withColumn("rank", F.row_number().over(Window.partitionBy("value").orderBy(order)))
    return top.where(F.col("rank") <= PIVOTS).groupBy("value").agg(F.sort_array(F.collect_list("node")).alias("pivots"))  # cut to so many before the shuffle


def node_links(nodes: DataFrame, docs: DataFrame, n: int, k: int, threshold: float) -> DataFrame:
    """Components over ``nodes``: (u, v) with v the least node of u's component."""
    pair = [F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")]
    lists = written(inverted_lists(nodes, k, threshold), "lists")
    sizes = lists.groupBy("value").agg(F.count("*").alias("n"), F.max(F.struct("weight", "node")).alias("top"))
    shared = lists.join(sizes.where("n > 1"), "value")
    short = shared.where(F.col("n") <= SHORT).select("value", "node")
    short = short.toDF("value", "a").join(short.toDF("value", "b"), "value").where("a < b").select("a", "b").distinct()
    long = written(shared.where(F.col("n") > SHORT).select("value", "node", "weight", F.col("top.node").alias("main")), "long")

    def linked(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        judged = written(union_filter(pairs, nodes, k, threshold), "judged")
        return judged, written(confirmed(judged.where("near").select("a", "b"), nodes, docs, n, threshold), "links")

    starred = long.select("node", F.col("main").alias("pivot")).where("node <> pivot").select(*pair).distinct()
    judged, links = linked(short.unionByName(starred).distinct())
    components = connected_components(links.toDF("u", "v"))
    if long.isEmpty():
        return components
    for number in range(ROUNDS):  # what lies outside a list's main component meets some members of it
        now = with_components(long, components)
        main = now.where("node = main").select("value", F.col("comp").alias("main_comp"))
        now = written(now.join(main, "value").select("value", "node", (F.col("comp") == F.col("main_comp")).alias("inside")), "now")
        share = now.groupBy("value").agg(F.count_if("inside").alias("n_in"), F.count("*").alias("n"))
        groups = now.join(share.where(f"n_in < n and n_in * {GROUP} >= n"), "value")
        some = pivots(groups.where("inside"), F.xxhash64("node", F.lit(number)))  # the same in all lists of a group
        met = groups.where("not inside").join(some, "value").select("node", "pivots").distinct()
        pairs = met.select("node", F.explode("pivots").alias("pivot")).select(*pair).distinct()
        more, found = linked(pairs.join(judged.select("a", "b"), ["a", "b"], "left_anti"))
        judged, links = judged.unionByName(more), links.unionByName(found)
        if found.isEmpty():
            break
        components = connected_components(links.toDF("u", "v"))

    # what each member of a long list is to the list's main node
    told = judged.join(links.withColumn("linked", F.lit(True)), ["a", "b"], "left").select("a", "b", "far", F.coalesce("linked", F.lit(False)).alias("linked"))
    told = told.union(told.select("b", "a", "far", "linked")).toDF("main", "node", "far", "linked")
    # lists with one main node are one cluster; each node is in it once
    now = with_components(long.select("main", "node").distinct(), components)
    main = now.where("node = main").select("main", F.col("comp").alias("main_comp"))
    rest = now.where("node <> main").join(main, "main").join(told, ["main", "node"])
    rest = written(rest.select("main", "node", "comp", "far", "linked", (F.col("comp") != F.col("main_comp")).alias("outside")), "rest")
    # outsiders meet one another, insiders that are not linked with the main node, and those that are if they are not far from that node
    side = lambda test, part, number: rest.where(test).select("main", F.lit(part).alias("part"), F.lit(number).alias("side"), "node", "comp")
    members = side("outside", WITHIN, 0).unionByName(side("outside", 0, 0)).unionByName(side("not linked and not outside", 0, 1)).unionByName(side("outside and not far", 1, 0)).unionByName(side("linked", 1, 1))
    members = written(members.join(rest.where("outside").select("main").distinct(), "main", "left_semi"), "members")
    if members.isEmpty():
        return components
    found = block_links(members, full_sets(members, nodes, docs, n), threshold)
    return connected_components(links.unionByName(found).toDF("u", "v"))


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, k: int = K) -> DataFrame:
    """Each row's doc_id, n_shingles (long), component_id (least doc_id reachable over links) and kept."""
    return finished(docs.sparkSession, "near-duplicates", lambda: _near_duplicates(pick(docs, "doc_id", "text"), n, threshold, k))


def _near_duplicates(docs: DataFrame, n: int, threshold: float, k: int) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = written(docs.mapInArrow(functools.partial(_sketch, n=n, k=k), f"doc_id {id_type}, n_shingles long, key binary, sketch array<long>"), "sketches")
    nodes = rows.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    links = node_links(nodes, docs, n, k, threshold)
    comps = with_components(nodes.select("node", "key", "rep"), links)
    least = comps.groupBy("comp").agg(F.min("rep").alias("component_id"))
    labels = comps.join(least, "comp").select("key", "component_id")
    found = rows.select("doc_id", "n_shingles", "key").join(labels, "key", "left")
    component: Column = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of each component, one with the smallest doc_id (null is the largest); columns unchanged.

    Rows are told apart by doc_id and text together, so null ids and an id with several
    texts do no harm; rows that repeat both are one. Rows without words all stay. Texts are
    not copied: what goes is found by their hashes.
    """
    plain, text = by_place(docs, "text")
    doc_id = F.col(by_place(docs, "doc_id")[1])
    place = F.struct(doc_id.isNull().alias("gone"), doc_id.alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    found = near_duplicates(plain.select(place.alias("doc_id"), F.col(text).alias("text")), n, threshold)
    told = found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("quern_place")).agg(F.bool_or("kept").alias("quern_kept"), F.count("*").alias("quern_n"))
    told = written(told.where("not quern_kept or quern_n > 1"), "told")
    rows = plain.withColumn("quern_place", place)
    drop, again = (if_small(told.where(test).select("quern_place"), BROADCAST_ROWS) for test in ("not quern_kept", "quern_kept"))
    left = rows.join(drop, "quern_place", "left_anti")
    if told.where("quern_kept").isEmpty():
        return left.drop("quern_place").toDF(*docs.columns)
    once = rows.join(again, "quern_place", "left_semi").groupBy("quern_place").agg(F.first(F.struct(*plain.columns)).alias("r")).select("r.*")  # partly done before the shuffle
    return left.join(again, "quern_place", "left_anti").drop("quern_place").unionByName(once).toDF(*docs.columns)
