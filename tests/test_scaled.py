"""Operators whose keys have no bound: against plain versions, with ties, nulls and one key for everything."""

import os
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from quern.functions.query import Query, Term
from quern.operators import blocks, intervals, nearest, postings, scans, scopes, windows
from quern.plans import QUERIES, searching
from quern.sinks import scratch


@pytest.fixture
def plan(spark):
    def text(df):
        return df._jdf.queryExecution().executedPlan().toString()

    return text


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.fixture
def line(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b"]), i, rng.choice([None, "x", "y"]), rng.choice([1, 2, 3, 9]), rng.choice([None, 1, 5])) for i in range(300)]
    return spark.createDataFrame(rows, "k string, i int, v string, level int, n long").repartition(7)


@pytest.mark.parametrize("key", [[], ["k"], ["i"]])
def test_scans_equal_windows(spark, line, key):
    w = (line, key, ["i"])
    assert rows_of(scans.runs(*w, F.col("v"))) == rows_of(windows.runs(*w, F.col("v")))
    assert rows_of(scans.heading_stack(*w, "level", "v", 3)) == rows_of(windows.heading_stack(*w, "level", "v", 3))
    size = F.coalesce("n", F.lit(0))
    assert rows_of(scans.within_budget(*w, size, 40)) == rows_of(windows.within_budget(*w, size, 40))
    spans = line.withColumn("a", F.col("i") % 50).withColumn("b", F.col("a") + F.coalesce("n", F.lit(0)))
    assert rows_of(scans.clamped(spans, key, "a", "b", "i").agg(F.sum(F.col("b") - F.col("a")))) == rows_of(windows.clamped(spans, key, "a", "b").agg(F.sum(F.col("b") - F.col("a"))))
    assert scans.runs(line.limit(0), key, ["i"], F.col("v")).collect() == []


def test_no_task_has_a_whole_key(spark):
    """One key: its rows lie in as many ranges as any others."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = scans.scanned(spark.range(10_000).withColumn("k", F.lit(1)), ["k"], ["id"], s=scans.Scan("sum", F.col("id")))
        sizes = df.withColumn("at", F.spark_partition_id()).groupBy("at").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in sizes) < 9000 and df.agg(F.max("s")).first()[0] == sum(range(10_000))


def test_bins(spark, plan):
    rng = random.Random(1)
    spans = [(i, a, a + rng.choice([0, 1, 3, 4, 5, 60, 1000]), rng.choice("xy")) for i in range(120) for a in [rng.randint(-300, 300)]] + [(900, None, 5, "x"), (901, 3, None, "x"), (902, 9, 2, "y")]
    points = [(i, rng.choice([None, rng.randint(-320, 1300)]), rng.choice(["x", "y", None])) for i in range(150)] + [(7, 3, "x"), (7, 3, "x")]
    p, s = spark.createDataFrame(points, "p int, at long, k string"), spark.createDataFrame(spans, "s int, a long, b long, k string")
    held = lambda x, y: x is not None and None not in y[1:3] and y[1] <= x < y[2]
    df = intervals.binned_join(p, s, "at", "a", "b", width=4).select("p", "at", "s")
    assert rows_of(df) == sorted(repr((i, x, y[0])) for i, x, _ in points for y in spans if held(x, y))
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
    keyed = intervals.binned_join(p, s, "at", "a", "b", width=4, key=["k"]).select("p", "at", "s")
    assert rows_of(keyed) == sorted(repr((i, x, y[0])) for i, x, k in points for y in spans if held(x, y) and k == y[3])
    pairs = intervals.overlapping(s.select("s", "a", "b"), s.select("s", "a", "b"), "a", "b", width=4).select("s", "s_b")
    ok = [y for y in spans if None not in y[1:3] and y[1] < y[2]]
    assert rows_of(pairs) == sorted(repr((x[0], y[0])) for x in ok for y in ok if x[1] < y[2] and y[1] < x[2])
    counted = intervals.counted_inside(p, s, "at", "a", "b")
    assert rows_of(counted) == sorted(repr((x, sum(held(x, y) for y in spans))) for x in {x for _, x, _ in points if x is not None})
    assert intervals.binned_join(p, s.limit(0), "at", "a", "b", width=4).collect() == []


@pytest.mark.parametrize("key", [[], ["k"]])
def test_chain(spark, key):
    rng = random.Random(2)
    spans = [(rng.choice(["x", "y", None]), a, a + rng.choice([0, 0, 1, 2, 7, 30]), i) for i in range(150) for a in [rng.randint(0, 60)]] + [("x", None, 3, 900), ("x", 9, 2, 901)]
    want, ends = [], {}
    for s in sorted((s for s in spans if None not in s[1:3] and s[1] <= s[2]), key=lambda s: (s[1], s[2], s[3])):
        k = s[0] if key else 0
        if s[1] >= ends.get(k, -1):
            want.append(s)
            ends[k] = s[2]
    df = spark.createDataFrame(spans, "k string, a long, b long, i int")
    assert rows_of(intervals.disjoint_chain(df, key, "a", "b", "i")) == sorted(map(repr, want))
    assert intervals.disjoint_chain(df.limit(0), key, "a", "b", "i").collect() == []


@pytest.mark.parametrize("shape", ["spread", "cluster", "same", "few"])
def test_nearest(spark, shape):
    rng = random.Random(4)
    at = {"spread": lambda: rng.randint(-5000, 5000), "cluster": lambda: rng.randint(0, 9) if rng.random() < 0.95 else rng.randint(-10**6, 10**6), "same": lambda: 7, "few": lambda: rng.randint(-3, 3)}[shape]
    targets = [(i, at(), at(), rng.choice([1, 2])) for i in range(200)] + [(900, None, 3, 1)]
    points = [(i, rng.randint(-10_000, 10_000) if i % 2 else at(), at()) for i in range(80)] + [(100, None, 1)]
    want = sorted(repr((p, *min(((px - x) ** 2 + (py - y) ** 2, z, t) for t, x, y, z in targets if x is not None)[::-2])) for p, px, py in points if px is not None)
    p, t = spark.createDataFrame(points, "p int, x long, y long"), spark.createDataFrame(targets, "t int, x long, y long, z int")
    assert rows_of(nearest.nearest(p, t, ["p"], "t", [F.col("z")])) == want
    assert nearest.nearest(p, t.limit(0), ["p"], "t", [F.col("z")]).collect() == []


def test_in_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice("uv"), i, rng.choice(["a", "b", None]), rng.choice([None, None, i]), rng.random() < 0.1) for i in range(400)]
    state, want = {}, []
    for u, i, kind, value, clears in rows:
        want.append(repr((i, state.get((u, kind)))))
        if clears:
            state = {k: v for k, v in state.items() if k[0] != u}
        if value is not None:
            state[u, kind] = value
    df = spark.createDataFrame(rows, "u string, i int, kind string, value int, clears boolean")
    assert rows_of(scopes.in_force(df, ["u"], ["i"], F.col("kind"), F.col("value"), F.col("clears"), "now").select("i", "now")) == sorted(want)


def test_blocks_over_page_breaks(spark):
    lines = [("d", 0, 5, "intro"), ("d", 0, 10, "# one"), ("d", 0, 20, "be"), ("d", 0, 30, "gun "), ("d", 1, 5, "here."), ("d", 1, 20, "## two"), ("d", 1, 30, "next"), ("d", 1, 60, "after"), ("e", 0, 1, "alone.")]
    pictures = [("d", 1, 40, 50, "p"), ("d", 1, 45, 55, "q"), ("d", 1, 56, 58, "r"), ("f", 0, 0, 1, "s")]
    text = F.col("text")
    made = blocks.merged(spark.createDataFrame(lines, "doc string, page int, top int, text string"), spark.createDataFrame(pictures, "doc string, page int, top int, bottom int, ref string"), "doc", text.startswith("# "), text.startswith("## "), text.endswith("."), "ref")
    got = [(r.doc, r.chapter, r.section, r.type, r.page, r.last_page, r.text, r.pictures) for r in made.orderBy("doc", "block").collect()]
    assert got == [
        ("d", 0, 0, "paragraph", 0, 0, "intro", None), ("d", 1, 0, "paragraph", 0, 1, "begun here.", None), ("d", 1, 1, "paragraph", 1, 1, "next", None),
        ("d", 1, 1, "picture", 1, 1, None, ["p", "q"]), ("d", 1, 1, "picture", 1, 1, None, ["r"]), ("d", 1, 1, "paragraph", 1, 1, "after", None), ("e", 0, 0, "paragraph", 0, 0, "alone.", None), ("f", 0, 0, "picture", 0, 0, None, ["s"]),
    ]
    (section,) = blocks.nested(made, ["doc", "chapter", "section"]).where("doc = 'd' and section = 1").collect()
    assert [b.type for b in section.blocks] == ["paragraph", "picture", "picture", "paragraph"]


@pytest.fixture
def index(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(postings, "BLOCK", 8)
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(100)] + [None, "", "zq", "a" * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return texts, postings.build(rows, ["i"], [F.col("t")], f"file://{tmp_path}/index")


@pytest.mark.parametrize("terms", [[("ab", "ab", ())], [("ab", "cab", ()), ("c", "c", ())], [("abcab", "abcab", ("ab", "c a"))], [("zq", "zq", ())], [("yy", "yy", ())], [("yy", "ba", ()), ("zx", "zx", ("a", "b"))]])
@pytest.mark.parametrize("few", [0, 1000])
def test_candidates_are_those_of_a_scan(index, monkeypatch, terms, few):
    monkeypatch.setattr(postings, "FEW_ROWS", few)
    texts, ix = index
    grams = lambda t: {*t, *(t[i : i + 2] for i in range(len(t) - 1))}
    has = lambda t, w: set(postings.word_grams(w)) <= grams(t or "")
    want = [i for i, t in enumerate(texts) if all(has(t, a) or has(t, b) or (ps and all(has(t, p) for p in ps)) for a, b, ps in terms)]
    q = Query(tuple(Term(*t) for t in terms), "", "x")
    assert sorted(r.i for r in postings.rows_of(ix, postings.candidates(ix, q)).collect()) == want


def test_index_parts(index):
    texts, ix = index
    assert ix.postings.agg(F.max(F.size("ids"))).first()[0] <= 8 and ix.postings.where("gram = 'a'").count() > 5  # a frequent gram is many rows
    assert postings.candidates(ix, Query((), "", "")) is None and ix.rows.count() == len(texts)
    assert {r.gram: r.df for r in ix.grams.collect()}["a"] == sum("a" in (t or "") for t in texts)


def test_index_follows_the_files(spark, tmp_path):
    write = lambda texts: spark.createDataFrame([(i, t, "en", "src1") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    find = lambda: [r.doc_id for r in searching.rare_phrase_rows(spark, str(tmp_path)).collect()]
    write(["a token here", "none"])
    assert find() == [0]
    write(["none", "x", "tokens"])
    assert find() == [2]


@pytest.mark.parametrize("name", ["lines_of_documents", "marked_words", "points_of_turns", "folded_hashes", "numerals_of_keys", "canonical_documents", "canonical_conversations", "spans_over_days"])
def test_plans_stay_in_the_jvm(spark, sf, plan, name):
    assert not re.search("Python|Pandas|Arrow|NestedLoop|Cartesian", plan(QUERIES[name](spark, sf)))


def test_scratch_is_cleared(spark, monkeypatch, tmp_path):
    def made(_, name):
        scratch._folders.add(folder := f"file://{tmp_path}/shared/{name}-{uuid.uuid4().hex}")
        return folder

    monkeypatch.setattr(scratch, "_folders", set())
    monkeypatch.setattr(scratch, "new_folder", made)
    df = scans.runs(spark.range(20).withColumn("v", F.lit(1)), [], ["id"], F.col("v"))
    assert df.count() == 20 and len(os.listdir(tmp_path / "shared")) == len(scratch._folders) == 2
    scratch.clear()
    assert os.listdir(tmp_path / "shared") == [] and not scratch._folders
