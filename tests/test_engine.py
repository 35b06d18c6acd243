"""Search, citations, sources, sinks and streams on small tables."""

import zipfile

from pyspark.sql import functions as F

from quern.functions.query import Vocabulary, compile_query
from quern.functions.text import normalize
from quern.operators import changes, citing, graph, joins, search
from quern.plans import QUERIES
from quern.sinks import tables
from quern.sources import records
from quern.streaming import versions

LAWS = [("A", 0, "建築法", "中央", "法律"), ("B", 1, "建築技術規則", "中央", "命令"), ("C", 2, "臺北市建築管理自治條例", "臺北市", "自治條例")]
ARTICLES = [
    ("A", 0, "第1條", "為實施建築管理，特制定本法。"), ("A", 1, "第2條", "本法所稱建築物，為定著於土地上之構造物。"), ("A", 2, "第77條", "建築物應依第一條維護。"), ("A", 3, "第77-1條", "防火避難設施不符者，依第七十七條及本法第二條辦理。"),
    ("B", 0, "第1條", "本規則依建築法（以下簡稱本法）第七十七條規定訂定之。"), ("B", 1, "第2條", "依建築法第一條至第七十七條之一辦理，並依同法第二條。"), ("B", 2, "第3條", "依本法第二條。"), ("C", 0, "第1條", "建築物防火門應符合未知法第三條之規定，及第二條。"),
]
VOCABULARY = Vocabulary({"建技": "建築技術規則"}, ("防火", "避難", "設施"))


def corpus(spark):
    laws = spark.createDataFrame(LAWS, "id string, ord int, name string, region string, kind string")
    laws = laws.select("*", normalize("name").alias("name_norm"), normalize("region").alias("region_norm"), F.lower("id").alias("id_norm"), F.array().cast("array<string>").alias("keywords_norm"))
    rows = spark.createDataFrame(ARTICLES, "law_id string, ord int, no string, text string")
    rows = rows.select("*", normalize("no").alias("no_norm"), F.regexp_replace(normalize("no"), "^第|條$", "").alias("address"), normalize("text").alias("body_norm"))
    return laws, rows


def ask(spark, text, **more):
    laws, rows = corpus(spark)
    return [(r.law_id, r.no, round(r.score, 3)) for r in search.search(laws, rows, compile_query(text, VOCABULARY), VOCABULARY, **more).collect()]


def test_title_stands_for_its_articles(spark):
    assert ask(spark, "建技") == [("B", None, 600.0)]
    assert ask(spark, "建築法")[0] == ("A", None, 600.0)
    assert ask(spark, "") == [] and ask(spark, "無此詞") == []


def test_article_number_binds_named_law(spark):
    assert [h[:2] for h in ask(spark, "建築法第77條之1")] == [("A", "第77-1條")]
    assert {h[0] for h in ask(spark, "第一條")} == {"A", "B", "C"}


def test_words_that_a_term_is_made_of(spark):
    hits = ask(spark, "防火設施")
    assert [h[:2] for h in hits] == [("A", "第77-1條")] and hits[0][2] < 150


def test_index_path_gives_the_same(spark):
    laws, rows = corpus(spark)
    index = search.postings(rows.join(laws.select(F.col("id").alias("law_id"), "name_norm"), "law_id"), ["law_id", "no"], [F.col("body_norm"), F.col("name_norm")])
    for text in ("防火", "防火設施", "建築物 維護", "第77條", "無此詞", "法 第二條"):
        q = compile_query(text, VOCABULARY)
        found = search.candidate_rows(index, ["law_id", "no"], q)
        assert ask(spark, text, candidates=found) == ask(spark, text), text


def test_relevance_prefers_definitions(spark):
    bodies = ["建築物:指房屋。", "房屋與建築物相鄰" + "文" * 300, "其他"]
    df = spark.createDataFrame([(b,) for b in bodies], "b string").select(search.relevance(F.col("b"), [["建築物"]]).alias("r"))
    a, b, c = (r.r for r in df.collect())
    assert a > b > c == 0


def test_rulings(spark):
    rows = [("1", 0, "第1151162993號", "1151162993", "防火門疑義", "有關防火門", "消防", "署", [("A", "第77條", "建築法第77條")]), ("2", 1, "第22號", "22", "其他", "提及防火門", "其他", "署", [])]
    df = spark.createDataFrame(rows, "id string, ord int, number_norm string, number_key string, title_norm string, body_norm string, topic_norm string, unit_norm string, refs array<struct<law:string,article_norm:string,evidence_norm:string>>")
    get = lambda q: [(r.id, r.score) for r in search.search_rulings(df, compile_query(q, VOCABULARY), VOCABULARY).collect()]
    assert get("1151162993") == [("1", 1020)]
    assert get("防火門") == [("1", 120), ("2", 20)]
    assert get("防火門 建築法第77條") == [] and [i for i, _ in get("防火門 第77條")] == ["1"]


def test_pages(spark):
    df = spark.createDataFrame([(1, "甲乙\n丙", "甲乙丙"), (2, "丁", "丁")], "page int, text string, body_norm string")
    assert [(r.page, r.score) for r in search.search_pages(df, compile_query("乙丙")).collect()] == [(1, 150)]


def test_citations(spark):
    laws, rows = corpus(spark)
    texts = rows.select(F.concat("law_id", F.lit("/"), "address").alias("key"), "law_id", F.lit(0).alias("paragraph"), "text")
    found = {(r.key, r.target_law, r.address, r.resolution) for r in citing.found_citations(texts, "key", laws, rows).collect()}
    assert ("A/77", "A", "1", "source") in found
    assert {("A/77-1", "A", "77", "source"), ("A/77-1", "A", "2", "self")} <= found
    assert {("B/2", "A", a, "named") for a in ("1", "2", "77", "77-1")} <= found
    assert ("B/2", "A", "2", "paragraph") in found
    assert ("B/1", "A", "77", "named") in found and ("B/3", "A", "2", "alias") in found
    assert [tuple(r) for r in citing.declared_aliases(rows, laws).collect()] == [("B", "本法", "A")]
    assert not any(k.startswith("C/") for k, *_ in found)  # an unknown law leaves what follows without one


def test_definitions(spark):
    laws, rows = corpus(spark)
    defined = citing.law_definitions(rows, laws)
    assert [(r.law_id, r.term, r.no) for r in defined.collect()] == [("A", "建築物", "第2條")]
    assert {(r.no, r.term, r.start) for r in citing.definition_uses(rows, defined).collect()} == {("第77條", "建築物", 0)}


def test_basis_relations(spark):
    laws, rows = corpus(spark)
    plain = rows.withColumn("text", F.regexp_replace("text", "（以下簡稱本法）", ""))
    assert [(r.parent, r.child) for r in citing.basis_relations(plain, laws).collect()] == [("A", "B")]


def test_units_have_ids(spark):
    df = spark.createDataFrame([("A", "第1條", "1", "依下列：\n一、甲。\n二、乙。")], "law_id string, no string, address string, text string")
    assert [(r.unit_id, r.parent_id) for r in citing.article_units(df).collect()] == [("A/a:1/p:1", None), ("A/a:1/p:1/i:1", "A/a:1/p:1"), ("A/a:1/p:1/i:2", "A/a:1/p:1")]


def test_graph_cycle_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "from string, to string")
    got = graph.descendants(edges, spark.createDataFrame([("a",)], "root string")).where("node <> root")
    assert sorted((r.node, r.depth) for r in got.collect()) == [("b", 1), ("c", 2)]


def test_greedy_spans(spark):
    df = spark.sql("SELECT array(named_struct('start', 0, 'end', 5), named_struct('start', 3, 'end', 9), named_struct('start', 5, 'end', 6)) AS s")
    assert [(x.start, x.end) for x in df.select(joins.greedy_disjoint(F.col("s")).alias("k")).first().k] == [(0, 5), (5, 6)]


def test_archive_runs_twice_without_change(spark, tmp_path):
    batch = tables.with_hash(spark.createDataFrame([("A", "t1", "x"), ("B", "t1", None)], "law string, recorded_at string, text string"), "text")
    path = f"file://{tmp_path}/archive"
    tables.append_versions(None, batch, path)
    tables.append_versions(spark.read.parquet(path), batch.withColumn("recorded_at", F.lit("t2")), path)
    assert spark.read.parquet(path).count() == 2
    edit = tables.with_hash(spark.createDataFrame([("A", "t3", "y")], "law string, recorded_at string, text string"), "text")
    tables.append_versions(spark.read.parquet(path), edit, path)
    assert spark.read.parquet(path).where("previous_digest is not null").count() == 1


def test_watch_and_evidence(spark):
    a = spark.createDataFrame([("k", "h1", "s1"), ("gone", "h", "s")], "key string, digest string, source string")
    b = spark.createDataFrame([("k", "h1", "s2")], "key string, digest string, source string")
    assert {r.key: r.state for r in changes.watch_states(a, b, "key", "digest", "source").collect()} == {"k": "source-changed", "gone": "missing"}


def test_xml_with_a_bad_record(spark, tmp_path):
    good = "<Law><LawName>建築法</LawName><LawArticles><Article><ArticleType>A</ArticleType><ArticleNo>第 1 條</ArticleNo><ArticleConctent>文</ArticleConctent></Article><Article><ArticleType>A</ArticleType><ArticleNo>第 2 條</ArticleNo><ArticleContent>字</ArticleContent></Article></LawArticles></Law>"
    (tmp_path / "a.xml").write_text(f"<Laws>{good}<Law><LawArticles/></Law></Laws>")
    laws, bad = records.xml_laws(spark, str(tmp_path / "a.xml"))
    assert [r.text for r in records.xml_articles(laws).collect()] == ["文", "字"] and bad.count() == 1


def test_html(spark):
    html = "<p>甲&amp;乙<script>x</script><table><tr><td>第 1 條<td>文<br>二</table>"
    df = spark.createDataFrame([(1, html)], "id int, html string")
    assert df.select(records.html_text("html")).first()[0].split("\n")[0] == "甲&乙"
    assert [(r.no, r.text) for r in records.html_articles(df, "id").collect()] == [("第1條", "文\n二")]


def test_zip_and_pages(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.xml", "<a/>")
        z.writestr("y.txt", "n")
    assert [(r.member, bytes(r.content)) for r in records.zip_members(spark, str(tmp_path / "a.zip"), ".xml").collect()] == [("x.xml", b"<a/>")]
    assert [r.page for r in records.page_rows(spark.createDataFrame([(1, "a\fb\f")], "id int, text string"), "id").collect()] == [1, 2]


def test_casebook_keeps_what_still_has_its_hash(spark):
    q = "引文"
    import hashlib
    import json

    entry = {"id": "e", "title": "t", "quote": q, "contentHash": hashlib.sha256(q.encode()).hexdigest(), "note": ""}
    book = {"schemaVersion": 1, "folders": [{"id": "f", "name": "夾", "entries": [entry, entry | {"id": "x", "contentHash": "0"}]}]}
    got = records.casebook_entries(spark.createDataFrame([(json.dumps(book),)], "json string"))
    assert [r.id for r in got.collect()] == ["e"]
    assert tables.markdown(got).first().markdown.startswith("# 夾\n\n## t\n\n> 引文")


def test_routes(spark):
    df = spark.createDataFrame([("https://x.org/law/A#a-77-2-p1-i2",), ("https://x.org/rulings/12?q=%E7%94%B2",)], "url string")
    a, b = records.routes(df).collect()
    assert (a.law, a.article, a.unit) == ("A", "77-2", "-p1-i2") and (b.ruling, b.query) == ("12", "甲")


TABLE = """┌─┬──┐
│甲│乙乙│
├─┼──┤
│丙│丁  │
│  │戊  │
└─┴──┘
"""


def test_drawn_tables():
    from quern.functions.tables import cells_of

    assert cells_of(TABLE) == [(0, 0, 1, 1, "甲"), (0, 1, 1, 1, "乙乙"), (1, 0, 1, 1, "丙\n  "), (1, 1, 1, 1, "丁  \n戊  ")]
    assert cells_of("┌─┬─┐\n│甲│乙│\n└─┴─┘") == [(0, 0, 1, 1, "甲"), (0, 1, 1, 1, "乙")]
    joined = "┌──┬──┐\n│上    上  │\n├──┼──┤\n│左  │右  │\n└──┴──┘"
    assert cells_of(joined) is None  # the crossing leads up, where no line is
    assert cells_of(joined.replace("┬", "─").replace("┼", "┬")) == [(0, 0, 1, 2, "上    上  "), (1, 0, 1, 1, "左  "), (1, 1, 1, 1, "右  ")]
    tall = "┌──┬──┐\n│甲  │ab  │\n├──┤字字│\n│丙  │    │\n└──┴──┘"
    assert cells_of(tall)[1] == (0, 1, 2, 1, "ab  \n字字\n    ")
    for broken in ("甲\n乙", "┌─┐\n│a│", TABLE.replace("├─", "├ "), TABLE.replace("丁  ", "丁\t"), TABLE.replace("┌", "╔"), TABLE.replace("乙乙│", "乙乙│x"), TABLE.replace("丁  ", "丁 ")):
        assert cells_of(broken) is None, broken


def test_evidence_functions(spark):
    from quern.operators import evidence

    df = spark.createDataFrame([("1", "依內授營字第１１５１１６２９９３號及第一一五一一六二九九四號函"), ("2", "第12號")], "id string, t string")
    assert [list(r) for r in df.select(evidence.serial_numbers(F.col("t"))).collect()] == [[["1151162993", "1151162994"]], [[]]]
    numbers = spark.createDataFrame([("1151162994", "9"), ("1151162993", "1")], "number_key string, id string")
    links = evidence.serial_links(df.withColumnRenamed("id", "key"), "key", "t", numbers)
    assert [(r.key, r.id) for r in links.collect()] == [("1", "9")]
    a = spark.createDataFrame([("A", "第77條之1", "文")], "law_id string, no string, text string")
    row = evidence.enriched_articles(a).first()
    assert (row.address, row.id, row.anchor) == ("77-1", "A/a:77-1", "a-77-1")
    laws = spark.createDataFrame([("A", "n", "t1")], "id string, name string, retrieved string")
    assert evidence.canonical(laws).columns == ["id", "name"]
    text = "依下列：\n一、甲。\n二、乙。"
    arts = spark.createDataFrame([("A", "第1條", "1", text)], "law_id string, no string, address string, text string")
    assert evidence.citation_targets(arts, citing.article_units(arts)).first()["items"] == [2]
    pages = spark.createDataFrame([(1, "第一章 總則\n文"), (2, "文"), (3, "附錄 甲")], "page int, text string")
    assert [(r.page, r.title) for r in evidence.outline(pages).collect()] == [(1, "第一章 總則"), (3, "附錄 甲")]
    words = spark.createDataFrame([(800.0, "12"), (800.0, "文"), (100.0, "12")], "top double, text string")
    assert evidence.without_footers(words).count() == 2


def test_stream_of_versions(spark, tmp_path):
    rows = [("A", 1, "h1"), ("A", 2, "h1"), ("A", 3, "h2"), ("B", 1, "h1")]
    spark.createDataFrame(rows, "law string, at long, digest string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("law string, at long, digest string").parquet(f"{tmp_path}/in")
    q = versions.changed_versions(stream, "law", "at", "digest").writeStream.format("memory").queryName("changed").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.law, r.at, r.previous) for r in spark.table("changed").collect()) == [("A", 1, None), ("A", 3, "h1"), ("B", 1, None)]


def test_names_in_texts_equal_a_plain_search(spark):
    """Names of any length, after punctuation and inside words; copies and nulls on both sides."""
    texts = [
        "the Civil Code applies", "see (Civil Code), \"Tax Act\" and non-Tax Act", "建築法第一條", "A", "", None, "x  y", "x y", "under [Act on Public Roads and Bridges]; ok", "Act on Public Roads", "the Civil Code applies",
        "pre-one two three four-post", "one\ttwo three", "😀é😀 mid", "a law of the sea, a law", " lead and trail ",
    ]
    names = ["Civil Code", "Tax Act", "建築法", "A", "", None, "x  y", "Act on Public Roads", "Act on Public Roads and Bridges", "one two three four", "two three four", "one two three", "Code", "😀é", " and ", "law of the sea", "Civil Code", "absent name", "absent name of six whole words", " "]
    t = spark.createDataFrame(list(enumerate(texts)), "t int, text string")
    n = spark.createDataFrame(list(enumerate(names)), "n int, name string")
    want = sorted((i, k) for i, a in enumerate(texts) for k, b in enumerate(names) if a is not None and b is not None and b in a)
    for words in (1, 2, 3):
        assert sorted((r.t, r.n) for r in joins.token_matches(t, "text", n, "name", words=words).collect()) == want
    assert joins.token_matches(t, "text", n.limit(0), "name").collect() == []


def test_dictionary_query_keeps_short_names(spark, tmp_path):
    spark.createDataFrame([(1, "see (Civil Code)."), (2, "civil code"), (1, "the Civil Code")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "Civil Code"), (8, "Code")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = QUERIES["dictionary_in_texts"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(1, 7), (1, 7), (1, 8), (1, 8)]
