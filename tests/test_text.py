"""Lookups in Chinese texts: numerals, normalisation, queries, segmentation."""

import hashlib
import json
import math
import random
import re
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import canonical, cuts, dates, segmenting, text
from quern.functions.numerals import address, chinese_number, cn_number
from quern.functions.query import Vocabulary, compile_query, parse_query
from quern.functions.text import fnv1a, normalize_text
from quern.sources import rulings


@pytest.mark.parametrize(("raw", "number"), [("七十七", "77"), ("十", "10"), ("一百零三", "103"), ("一千二百", "1200"), ("二〇三", "203"), ("77", "77"), ("兩百", "200"), ("十甲", "十甲"), ("", "")])
def test_numerals(raw, number):
    assert chinese_number(raw) == number


@given(st.integers(1, 9999))
def test_numerals_of_all_sizes(n):
    digits, out = "零一二三四五六七八九", ""
    for unit, name in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
        if d := n // unit % 10:
            out += digits[d] + name
        elif out and n % unit:
            out += "零" if not out.endswith("零") else ""
    assert chinese_number(out) == str(n) if any(u in out for u in "十百千") else True


@pytest.mark.parametrize(
    ("raw", "norm"),
    [("第七十七條之二", "第77-2條"), ("第77條之2", "第77-2條"), ("77條", "第77條"), ("第三之一點", "第3-1點"), ("台北　市", "臺北市"), ("ＡＢＣ", "abc"), ("建​築法", "建築法"), ("第二項第三款", "第2項第3款"), ("１–２", "1-2")],
)
def test_normalize(raw, norm):
    assert normalize_text(raw) == norm


@pytest.mark.parametrize(
    ("query", "terms", "article"),
    [("建築法 第77條之2", ["建築法"], "第77-2條"), ("建築法77-2", ["建築法"], "第77-2條"), ("§77-2", [], "第77-2條"), ("第七十七條之二", [], "第77-2條"), ("樓高 1.5", ["樓高", "1.5"], ""), ("H-2", ["h-2"], ""), ("1151162993", ["1151162993"], ""), ("防火,避難；設施", ["防火", "避難", "設施"], ""), ("第3點", [], "第3點")],
)
def test_parse_query(query, terms, article):
    assert parse_query(query) == (terms, article)


def test_compile_query():
    v = Vocabulary({"室裝": "建築物室內裝修管理辦法"}, ("防火", "防火門", "設備"))
    (term,) = compile_query("防火門設備", v).terms
    assert term.parts == ("防火門", "設備")
    assert compile_query("室裝", v).terms[0].value == "建築物室內裝修管理辦法"
    assert compile_query("防火窗", v).terms[0].parts == ()


def test_columns(spark):
    row = spark.createDataFrame([("民國 113 年 03 月 01 日", "甲乙甲", "七十七", "第77-1條")], "d string, t string, n string, a string").select(
        dates.any_date(F.col("d")).cast("string"), text.grams(F.col("t")), cn_number("n"), address(F.col("a")), text.normalize(F.lit("台北")), text.cell_width(F.lit("a甲"))
    ).first()
    assert list(row) == ["2024-03-01", ["甲", "乙", "甲乙", "乙甲"], "77", "77-1", "臺北", 3]


@pytest.mark.parametrize(("raw", "day"), [("民國113年2月30日", None), ("2024-05-06", "2024-05-06"), ("20240506", "2024-05-06"), ("99991231", None), ("", None), (None, None)])
def test_dates(spark, raw, day):
    assert spark.createDataFrame([(raw,)], "d string").select(dates.any_date(F.col("d")).cast("string")).first()[0] == day


def test_fnv():
    assert fnv1a("") == 0x811C9DC5
    assert fnv1a("a") == 0xE40C292C


ARTICLE = "本法用詞定義如下：\n一、甲物：指甲。\n（一）大。\n（二）小。\n二、乙物：指乙。"


def test_units():
    assert [(r[0], r[1]) for r in segmenting.unit_rows(ARTICLE)] == [("p:1", "paragraph"), ("p:1/i:1", "item"), ("p:1/i:1/s:1", "subitem"), ("p:1/i:1/s:2", "subitem"), ("p:1/i:2", "item")]
    p, i1, *_ = segmenting.unit_rows(ARTICLE)
    assert ARTICLE[p[3] : p[4]] == ARTICLE and ARTICLE[i1[3] : i1[4]].endswith("小。\n")
    for bad in ("一、無項。", "前項：\n二、跳號。", "未完\n下一行。", "表│格", "有：\n　縮排"):
        assert segmenting.unit_rows(bad) == []


@given(st.text("甲\n一二、（）│─。", max_size=40))
def test_cuts_lose_nothing(t):
    for one in (segmenting.unit_rows,):
        one(t)


def test_blocks_and_sections_are_lossless(spark):
    texts = ["前文\n┌─┐\n│甲│\n└─┘\n後文", "一、甲\n二、乙", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", segmenting.text_blocks("t").alias("b"), segmenting.sections(F.col("t"), "sectioned-points").alias("s")).collect()
    for r in rows:
        assert "".join(r.t[b.start : b.end] for b in r.b) == (r.t or "")
        assert "".join(s.text for s in r.s) == (r.t or "")
    assert [b.kind for b in rows[0].b] == ["text", "table", "text"]


def test_history(spark):
    raw = "1.中華民國八十年公布\n  全文十條\n2.中華民國九十年修正"
    (r,) = spark.createDataFrame([(raw,)], "t string").select(segmenting.history_entries("t").alias("h")).collect()
    assert [h.text for h in r.h] == ["1.中華民國八十年公布全文十條", "2.中華民國九十年修正"]


HEADS = "甲一二、（）第章 \n\t　1.x😀"


def test_native_spans_equal_python(spark):
    """Sections, points and matches by Spark's functions against Python's regular expressions."""
    rng = random.Random(0)
    texts = ["".join(rng.choice(HEADS) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", None]], "t string")
    found = df.select("t", *[segmenting.sections(F.col("t"), s).alias(f"s{i}") for i, s in enumerate(segmenting.STRATEGIES)], segmenting.spans(F.col("t"), "[甲一]+、?").alias("m")).collect()
    for r in found:
        for i, s in enumerate(segmenting.STRATEGIES.values()):
            edges = sorted({0, *(m.start() for m in re.finditer(s, r.t or "")), len(r.t or "")})
            assert [tuple(x) for x in r[f"s{i}"]] == [(a, b, r.t[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        assert [tuple(x) for x in r.m] == [(m.start(), m.end(), m[0]) for m in re.finditer("[甲一]+、?", r.t or "")]


def test_native_spans_of_a_long_text(spark):
    t = "".join(f"一、{i}\n" for i in range(5000))
    (r,) = spark.createDataFrame([(t,)], "t string").select(segmenting.sections(F.col("t"), "sectioned-points").alias("s")).collect()
    assert len(r.s) == 5000 and all(t[x.start : x.end] == x.text for x in r.s)
    (r,) = spark.createDataFrame([(list(range(70)),)], "n array<int>").select(cuts.running_sums(F.col("n")).alias("s")).collect()
    assert r.s == [sum(range(i + 1)) for i in range(70)]


def test_native_folds_equal_python(spark):
    rng = random.Random(0)
    pick = lambda signs, most: "".join(rng.choice(signs) for _ in range(rng.randint(0, most)))
    pairs = [(pick("零〇一二兩九十百千甲5○", 8), pick("a甲é😀\U0010ffff\x00", 12)) for _ in range(2000)]
    for r in spark.createDataFrame(pairs, "n string, t string").select("n", "t", cn_number("n").alias("c"), text.fnv1a_hash(F.col("t")).alias("h"), text.hash_fraction("t").alias("f")).collect():
        assert (r.c, r.h, r.f) == (chinese_number(r.n), fnv1a(r.t), fnv1a(r.t) / 2**32)


def js(value):
    """Canonical JSON in Python; numbers as JavaScript writes them."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{js(k)}:{js(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(js, value)) + "]"
    if isinstance(value, float):
        if not math.isfinite(value):
            return "null"
        digits, exponent = (s := f"{Decimal(repr(abs(value))).normalize():e}".split("e"))[0].replace(".", ""), int(s[1])
        digits, point = digits.rstrip("0") or "0", exponent + 1
        if value == 0:
            return "0"
        if -6 < point <= 21:
            shown = digits + "0" * (point - len(digits)) if len(digits) <= point else digits[:point] + "." + digits[point:] if point > 0 else "0." + "0" * -point + digits
        else:
            shown = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
        return ("-" if value < 0 else "") + shown
    return json.dumps(value, ensure_ascii=False)


NESTED = "b string, a struct<z: array<double>, y: map<string, struct<k: int, j: boolean>>>, c double, d bigint"


def test_canonical_json(spark):
    rng = random.Random(0)
    some = lambda f: None if rng.random() < 0.1 else f()
    real = lambda: rng.choice([0.0, -0.0, math.inf, math.nan, 1e21, 1e-7, 1e-6, 123456789.125, rng.gauss(0, 1), float(f"{rng.gauss(0, 1):.14e}") * 10.0 ** rng.randint(-40, 40), float(f"{rng.random():.{rng.randint(0, 14)}e}"), float(rng.randint(-(2**53), 2**53))])
    word = lambda: "".join(rng.choice('a"\\\n\x01\x1f\x7f甲😀/') for _ in range(rng.randint(0, 6)))
    entry = lambda: (some(lambda: rng.randint(-5, 5)), rng.random() < 0.5)
    rows = [(some(word), [some(real) for _ in range(rng.randint(0, 3))], some(lambda: {word(): some(entry) for _ in range(rng.randint(0, 3))}), real(), rng.randint(-(2**63), 2**63 - 1)) for _ in range(2000)]
    df = spark.createDataFrame([(b, (z, y), c, d) for b, z, y, c, d in rows], NESTED)
    got = df.select(canonical.row_json(df).alias("j"), canonical.digest(df).alias("h"), canonical.row_json(df, keep_nulls=False, drop=frozenset({"z"})).alias("n")).collect()
    for (b, z, y, c, d), r in zip(rows, got, strict=True):
        entries = None if y is None else {k: None if v is None else {"k": v[0], "j": v[1]} for k, v in y.items()}
        want = js({"b": b, "a": {"z": z, "y": entries}, "c": c, "d": d})
        assert r.j == want and r.h == hashlib.sha256(want.encode()).hexdigest()
        kept = None if y is None else {k: {n: x for n, x in v.items() if x is not None} for k, v in entries.items() if v is not None}
        assert r.n == js({k: v for k, v in {"b": b, "a": {} if kept is None else {"y": kept}, "c": c, "d": d}.items() if v is not None})


@pytest.mark.parametrize(("header", "day"), [("內政部８４年３月５日台內營字第1號函", "1995-03-05"), ("內政部84.3.5函", "1995-03-05"), ("８４．１３．５", ""), ("１１３／２／２９", "2024-02-29")])
def test_issued(spark, header, day):
    assert spark.createDataFrame([(header,)], "h string").select(rulings.issued(F.col("h"))).first()[0] == day


@pytest.mark.parametrize(("before", "begins"), [("依〇", False), ("㐀", False), ("々", False), ("𠀀", False), ("依", True), ("依據", True), ("", True), ("a", True), ("。", True), ("甲", False)])
def test_boundary(spark, before, begins):
    assert spark.createDataFrame([(before,)], "b string").select(segmenting.at_boundary(F.col("b"))).first()[0] is begins
