"""Worked examples over small tables of laws, articles and letters; SQL computes the same rows, or states them where it has no such functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import chains, links, numerals, segmenting, tables, text
from quern.functions.query import Vocabulary, compile_query
from quern.operators import citing, evidence, filters, graph, joins, reading, reports, search
from tests.worked.fixtures import fixture, laws_and_articles, values, with_tables
from tests.worked.registry import query
from quern.sources import rulings

VOCABULARY = Vocabulary({"門": "防火門"}, ("防火", "避難", "設施"))


def one_column(spark: SparkSession, kind: str, items: list) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")


def given(kind: str, pairs: list[tuple], out: str = "string") -> str:
    """Rows (i, out) for inputs with known results, as SQL."""
    return values(f"i int, v {kind}, out {out}", [(i, v, o) for i, (v, o) in enumerate(pairs)])


def checked(spark: SparkSession, kind: str, pairs: list[tuple], f) -> DataFrame:
    return one_column(spark, kind, [v for v, _ in pairs]).select("i", "v", f(F.col("v")).alias("out"))


# names, numbers, normal forms

NUMBERS = [("七十七", "77"), ("一百零五", "105"), ("十", "10"), ("二〇二", "202"), ("77", "77"), ("兩百", "200"), ("甲", "甲"), ("", "")]


@query(given("string", NUMBERS))
def chinese_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, "string", NUMBERS, numerals.cn_number)


NORMAL = [("第七十七條之一", "第77-1條"), ("台北市 建築法", "臺北市建築法"), ("ＡＢ－c", "ab-c"), ("第三點", "第3點"), ("七十七條", "第77條"), ("第 5 之 2 點", "第5-2點"), ("第二項第三款", "第2項第3款")]


@query(given("string", NORMAL))
def normal_forms(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, "string", NORMAL, text.normalize)


ADDRESSES = [("第七十七條之一", "77-1"), ("第3點", "3"), ("第十條", "10")]


@query(given("string", ADDRESSES))
def article_addresses(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, "string", ADDRESSES, links.article_address)


KINDS = [("建築法", "法"), ("臺北市建築管理自治條例", "自治條例"), ("消防手冊", ""), ("作業要點", "要點")]


@query(given("string", KINDS))
def law_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, "string", KINDS, chains.kind_of)


CATEGORIES = [("新北市都市更新要點", "都市更新與危老"), ("防火規則", "消防與公共安全"), ("農舍辦法", "農業與山坡地"), ("土地辦法", "都市計畫與土地"), ("廣告物辦法", "使用與室內裝修"), ("建築法", "建築與設計")]


@query(given("string", CATEGORIES))
def law_categories(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, "string", CATEGORIES, rulings.category)


CLEAN = [("臺北市建築條例(110.5.6訂定)", "臺北市建築條例"), ("建築法", "建築法"), ("規則(99年1月2日修正)", "規則")]


@query(given("string", CLEAN))
def clean_names(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, "string", CLEAN, chains.clean_name)


SERIALS = [("８４１２３４５號", "8412345"), ("一一五〇 號", "1150"), ("第12號", "第12")]


@query(given("string", SERIALS))
def serial_digits(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, "string", SERIALS, links.serial_digits)


NAMED_IN = [("依內授營字第１１５１１６２９９３號及第一一五一一六二九九四號函", "1151162993,1151162994"), ("第12號", "")]


@query(given("string", NAMED_IN))
def serials_in_texts(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, "string", NAMED_IN, lambda v: F.array_join(evidence.serial_numbers(v), ","))


DAYS = [("2026-09-30T01:02:03Z", "2026-09-30"), ("2020-01-02", "2020-01-02"), ("", "未提供"), (None, "未提供")]


@query(given("string", DAYS))
def date_texts(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, "string", DAYS, links.date_text)


AMOUNTS = [(1234567, "1,234,567"), (999, "999"), (0, "0"), (1000, "1,000")]


@query(given("long", AMOUNTS))
def grouped_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, "long", AMOUNTS, links.grouped_number)


STATUS = [("本函停止適用", "mentioned"), ("不再援引前函", "mentioned"), ("請查照", "unchecked")]


@query(given("string", STATUS))
def repeal_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, "string", STATUS, chains.mentions_repeal)


PREVIEWS = [("主旨：關於  室內\n裝修", "關於 室內 裝修"), ("說明:甲", "甲"), ("x" * 230, "x" * 220 + "…")]


@query(given("string", PREVIEWS))
def previews(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, "string", PREVIEWS, text.preview)


LOGS = [("GET https://me:pw@host/x", "GET https://***@host/x"), ("Authorization: Bearer abc.def", "Authorization: Bearer ***"), ("token=abc next", "token=*** next"), ("plain", "plain")]


@query(given("string", LOGS))
def redacted_logs(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, "string", LOGS, text.redact_logs)


FRACTIONS = [("", 2166136261 / 2**32), ("a", 0xE40C292C / 2**32), ("foobar", 0xBF9CF968 / 2**32)]


@query(given("string", FRACTIONS, "double"))
def hash_fractions(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, "string", FRACTIONS, text.hash_fraction)


WIDTHS = [("甲a─", 5), ("é", 2), ("é", 1), ("a\tb", 6), ("\xa0。", 3)]


@query(given("string", WIDTHS, "long"))
def text_widths(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, "string", WIDTHS, tables.text_width)


BEFORE = [("", True), ("依", True), ("甲", False), ("，", True), ("違反", True), ("新建築", False), ("a", True)]


@query(given("string", BEFORE, "boolean"))
def name_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, "string", BEFORE, segmenting.at_boundary)


COVERAGE = [("full", True, "full"), ("link", True, "document"), ("link", False, "link")]


@query(values("coverage string, document boolean, class string", COVERAGE))
def coverage_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([r[:2] for r in COVERAGE], "coverage string, document boolean")
    return rows.select("*", chains.coverage_class(F.col("coverage"), F.col("document")).alias("class"))


QUOTES = [("中文字", "甲中文字乙", True), ("", "甲", False), ("丙", "甲乙", False), ("甲乙丙丁戊己", "甲乙丙丁戊己", False)]


@query(values("quote string, text string, ok boolean", QUOTES))
def valid_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([r[:2] for r in QUOTES], "quote string, text string")
    return rows.select("*", filters.valid_excerpt(F.col("quote"), F.col("text"), 5).alias("ok"))


PARSED = [("建築法第77條之1 樓梯", "建築法 樓梯", "第77-1條"), ("建技90", "建技", "第90條"), ("§12-3", "", "第12-3條"), ("樓梯，寬度", "樓梯 寬度", ""), ("第三點", "", "第3點")]


@query(values("query string, words string, article string", PARSED))
def parsed_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Queries are parsed once, on the driver."""
    rows = [(q, " ".join(t.literal for t in compile_query(q).terms), compile_query(q).article) for q, _, _ in PARSED]
    return spark.createDataFrame(rows, "query string, words string, article string")


COMPILED = [("防火避難", "防火避難", "防火避難", "防火 避難"), ("門", "門", "防火門", ""), ("樓梯", "樓梯", "樓梯", "")]


@query(values("query string, literal string, value string, parts string", COMPILED))
def compiled_terms(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(q, t.literal, t.value, " ".join(t.parts)) for q, *_ in COMPILED for t in compile_query(q, VOCABULARY).terms]
    return spark.createDataFrame(rows, "query string, literal string, value string, parts string")


# addresses and descriptions


@query(with_tables("""SELECT id, '/laws/' || id || '.html' AS whole, '/laws/' || id || '.html#a-77-1' AS article, '/laws/' || id || '.html#a-77-p-1-i-2' AS unit, '/laws/' || id || '.html#document-page-3' AS page FROM laws""", "laws"))
def law_addresses(spark: SparkSession, sf: str) -> DataFrame:
    none, law = F.lit(None).cast("string"), F.col("id")
    unit = F.concat(law, F.lit("/a:77/p:1/i:2"))
    return fixture(spark, "laws").select(
        "id", links.law_href(law, none, none, F.lit(0)).alias("whole"), links.law_href(law, F.lit("第七十七條之一"), none, F.lit(0)).alias("article"),
        links.law_href(law, F.lit("第1條"), unit, F.lit(0)).alias("unit"), links.law_href(law, none, unit, F.lit(3)).alias("page"),
    )


@query(with_tables("""SELECT id, CASE WHEN id = 'A' THEN 'https://law.moj.gov.tw/LawClass/LawSingle.aspx?pcode=D0070109&flno=77-1' WHEN id = 'B' THEN 'https://law.moj.gov.tw/LawClass/LawSingle.aspx?pcode=D0070114&flno=77-1'
WHEN id = 'C' THEN 'https://law.moj.gov.tw/LawClass/LawSingle.aspx?pcode=D0070115&flno=77-1' WHEN id = 'F' THEN 'https://web.law.ntpc.gov.tw/Scripts/FLAWDOC01.aspx?fcode=C1234567&flno=77-1' WHEN id = 'E' THEN NULL ELSE url END AS url,
CASE WHEN id <> 'E' THEN id <> 'D' END AS exact FROM laws""", "laws"))
def official_articles(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, "laws").select("id", links.official_article(F.col("url"), F.lit("第77條之1")).alias("o")).select("id", "o.url", "o.exact")


@query(with_tables("""SELECT id, region || '・' || kind || '。《' || name || '》' || CASE WHEN has_document THEN '收錄 12 頁官方圖文 PDF（未拆為項款）' WHEN coverage = 'full' THEN '收錄 7 條原文快照' ELSE '官方來源索引，全文尚未收錄' END || '。' ||
CASE WHEN modified <> '' THEN '來源修正日期：' || modified || '。' ELSE '' END || '查閱條文、相關函釋與官方來源。' AS description FROM laws""", "laws"))
def law_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    kind = F.when(c("has_document"), "pdf")
    return fixture(spark, "laws").select("id", links.law_description(c("region"), c("kind"), c("name"), c("coverage"), F.lit(7), F.lit(12), kind, c("modified")).alias("description"))


@query(with_tables("""SELECT id, CASE id WHEN 'e1' THEN 'https://x.org/embed.html?law=A&article=%E7%AC%AC77%E6%A2%9D&unit=A%2Fa%3A77%2Fp%3A1%2Fi%3A2&expected=' || content_hash WHEN 'e2' THEN 'https://x.org/embed.html?ruling=101&expected=' || content_hash END AS url FROM evidence""", "evidence"))
def embed_addresses(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return fixture(spark, "evidence").select("id", links.embed_url(F.lit("https://x.org/a?b"), c("kind"), c("law"), c("article"), c("unit"), c("ruling"), c("content_hash")).alias("url"))


SELECTORS = [("ruling=101&expected=", "ruling", None, "101"), ("law=A&article=%E7%AC%AC1%E6%A2%9D", "article", "A", None), ("law=A", None, None, None), ("ruling=1x", None, None, None), ("ruling=1&law=A&article=2", None, None, None), ("law=A&article=1&expected=zz", None, None, None)]


@query(values("search string, kind string, law string, ruling string", SELECTORS))
def embed_selectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(s[0],) for s in SELECTORS], "search string")
    return rows.select("search", links.embed_selector(F.col("search")).alias("s")).select("search", "s.kind", "s.law", "s.ruling")


@query(with_tables("""SELECT 'article' AS kind, a.law_id AS key, a.text AS quote, sha256(a.text) AS content_hash FROM articles a WHERE law_id = 'A' AND no = '第77-1條' UNION ALL SELECT 'ruling', '102', '請依建築法辦理，並依內政部第8412345號函。', sha256('請依建築法辦理，並依內政部第8412345號函。')""", "articles"))
def embedded_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Cards' selectors -> the article or letter that they name."""
    asked = spark.createDataFrame([("law=A&article=%E7%AC%AC77%E6%A2%9D%E4%B9%8B1",), ("ruling=102",), ("ruling=9",), ("law=",)], "search string")
    articles = fixture(spark, "articles").select("law_id", "no", "text", links.article_address(F.col("no")).alias("address"))
    return evidence.embedded(asked.select(links.embed_selector(F.col("search")).alias("s")).select("s.*"), articles, rulings.ruling_rows(fixture(spark, "rulings"))).select("kind", "key", "quote", "content_hash")


ARCHIVES = [(0, True, "過往僅保留雜湊觀測，未保存可還原正文。"), (0, False, "尚未建立可還原的版本封存。"), (1, False, "已保存 1 個完整版本；封存基準之前的歷史正文尚未收錄。"), (3, True, "已保存 3 個完整版本。這是本庫觀測歷程，不代表官方全部歷史版本。")]


@query(values("n int, hashed boolean, status string", ARCHIVES))
def archive_states(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([r[:2] for r in ARCHIVES], "n int, hashed boolean")
    return rows.select("*", links.archive_status(F.col("n"), F.col("hashed")).alias("status"))


# reading


@query(with_tables("""SELECT law_id, no, chapter, chapter_title FROM articles JOIN (VALUES ('A', 0, 'chapter-0', '第一章 總則'), ('A', 1, 'chapter-0', '第一章 總則'), ('A', 2, 'chapter-1', '第二章 使用'), ('A', 3, 'chapter-1', '第二章 使用'), ('B', 0, 'chapter-0', '未分章條文'),
('B', 1, 'chapter-0', '未分章條文'), ('B', 2, 'chapter-0', '未分章條文'), ('C', 0, 'chapter-0', '第一編'), ('C', 1, 'chapter-0', '第一編'), ('D', 0, 'chapter-0', '未分章條文')) c(law_id, ord, chapter, chapter_title) USING (law_id, ord)""", "articles"))
def law_chapters(spark: SparkSession, sf: str) -> DataFrame:
    return reading.with_chapters(fixture(spark, "articles")).select("law_id", "no", "chapter", "chapter_title")


@query(with_tables("SELECT 'all' AS asked, law_id, no FROM articles UNION ALL SELECT 'chapter', law_id, no FROM articles WHERE law_id <> 'A' OR ord >= 2 UNION ALL SELECT 'word', law_id, no FROM articles WHERE text LIKE '%本法%'", "articles"))
def chapter_views(spark: SparkSession, sf: str) -> DataFrame:
    """Without a query all or one chapter (all of a law that lacks it); a query looks in every chapter."""
    rows = reading.with_chapters(laws_and_articles(spark)[1])
    views = {"all": ("", "all"), "chapter": ("", "chapter-1"), "word": ("本法", "chapter-1")}
    out = [reading.visible_articles(rows, compile_query(q), c).select(F.lit(k).alias("asked"), "law_id", "no") for k, (q, c) in views.items()]
    return out[0].union(out[1]).union(out[2])


@query(with_tables("SELECT law_id, no FROM articles WHERE no = '第1條' AND text LIKE '%依%'", "articles"))
def in_law_search(spark: SparkSession, sf: str) -> DataFrame:
    return reading.in_law(laws_and_articles(spark)[1], compile_query("第一條 依")).select("law_id", "no")


@query(with_tables("SELECT law_id, no, '整部法規' AS label FROM articles WHERE law_id = 'A' UNION ALL SELECT law_id, no, '第二章 使用' FROM articles WHERE law_id = 'A' AND ord >= 2 UNION ALL SELECT law_id, no, no FROM articles WHERE law_id = 'A' AND no = '第77-1條'", "articles"))
def print_scopes(spark: SparkSession, sf: str) -> DataFrame:
    laws, articles = fixture(spark, "laws"), fixture(spark, "articles").where("law_id = 'A'")
    scopes = [reading.print_selection(laws, articles, *s).select("law_id", "no", "label") for s in (("law",), ("chapter", "chapter-1"), ("article", "第七十七條之一"))]
    return scopes[0].union(scopes[1]).union(scopes[2])


@query(values("section_id string, title string, at int", [("s1", "總則", 2)]) + " UNION ALL " + values("section_id string, title string, at int", [("s2", "檢查", 0)]))
def document_sections(spark: SparkSession, sf: str) -> DataFrame:
    """An anchor named like the needle goes before one whose text holds it."""
    sections, anchors = fixture(spark, "sections"), fixture(spark, "anchors")
    found = reading.section_hits(sections, anchors, "防火門").union(reading.section_hits(sections, anchors, "每年"))
    return found.select("section_id", "title", F.col("anchor").alias("at"))


@query(values("law_id string, page int", [("F", 1), ("F", 2), ("F", 3)]))
def pages_with_word(spark: SparkSession, sf: str) -> DataFrame:
    return reading.pages_with(fixture(spark, "doc_pages"), "防火門").select("law_id", "page")


@query(with_tables("SELECT id FROM laws WHERE coverage = 'full' OR has_document", "laws"))
def searchable_laws(spark: SparkSession, sf: str) -> DataFrame:
    return reading.searchable(fixture(spark, "laws")).select("id")


@query(with_tables("SELECT max(ord) AS ord, site, id FROM jobs WHERE site <> '內政部' AND name NOT LIKE '桃園縣%' AND name NOT LIKE '%消費者%' GROUP BY site, id", "jobs"))
def eligible_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return reading.eligible_jobs(fixture(spark, "jobs"), ["內政部", "農業部"], ["桃園縣"], ["消費者", "農作物污染"]).select("ord", "site", "id")


@query(with_tables("SELECT title FROM resources WHERE category = '法規查詢' AND region IN ('中央', '臺北市') UNION ALL SELECT title FROM resources WHERE category = '函釋'", "resources"))
def region_resources(spark: SparkSession, sf: str) -> DataFrame:
    r = fixture(spark, "resources")
    return reading.resources_for(r, "法規查詢", "臺北市").select("title").union(reading.resources_for(r, "函釋", "全台", most=5).select("title"))


@query(values("id string", [("101",)]))
def explored_rulings(spark: SparkSession, sf: str) -> DataFrame:
    rows = rulings.ruling_rows(fixture(spark, "rulings"))
    saved = spark.createDataFrame([("101",), ("102",)], "id string")
    return reading.explored_rulings(rows, saved, "使用與室內裝修", mentioned=True).select("id")


TOPICS = [("防火", "防火|消防"), ("更新", "都市更新"), ("農舍", "農舍"), ("建築", "建築")]


@query(values("mode string, topic string, n_laws long", [("gaps", "農舍", 0), ("full", "建築", 4), ("document", "防火", 1), ("link", "更新", 1), ("all", "防火", 1), ("all", "更新", 1), ("all", "農舍", 0), ("all", "建築", 4)]))
def coverage_modes(spark: SparkSession, sf: str) -> DataFrame:
    laws = fixture(spark, "laws")
    out = None
    for mode in ("gaps", "full", "document", "link", "all"):
        one = reading.coverage_checklist(laws, TOPICS, mode, "台北").select(F.lit(mode).alias("mode"), "topic", F.col("n_laws").cast("long").alias("n_laws"))
        out = one if out is None else out.union(one)
    return out


@query(values("pos int, id string", [(0, "C"), (1, "A"), (2, "B"), (3, "E"), (4, "D"), (5, "F")]))
def ordered_laws(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame([("建築技術規則建築設計施工編", 0), ("建築法", 1), ("新北市都市更新作業要點", 2)], "name string, ord int")
    rows = [r["id"] for r in reading.ordered_laws(fixture(spark, "laws"), names).select("id").collect()]  # six laws; their order is the result
    return spark.createDataFrame(list(enumerate(rows)), "pos int, id string")


@query(values("name string, region_ord int", [("臺北市", 0), ("高雄市", 5), ("連江縣", 21), ("中央", None)]))
def ordered_regions(spark: SparkSession, sf: str) -> DataFrame:
    return reading.ordered_regions(spark.createDataFrame([("連江縣",), ("臺北市",), ("中央",), ("高雄市",)], "name string"))


@query(with_tables("SELECT id, row_number() OVER (PARTITION BY CAST(id AS BIGINT) // 256 ORDER BY CAST(id AS BIGINT)) AS place FROM rulings", "rulings"))
def rulings_in_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.in_buckets(fixture(spark, "rulings"), "id").select("id", "place")


# segmentation, tables, definitions, citations


UNITS = [("A/a:77/p:1", None, "paragraph", 1), ("A/a:77/p:1/i:1", "A/a:77/p:1", "item", 1), ("A/a:77/p:1/i:2", "A/a:77/p:1", "item", 2)]


@query(values("unit_id string, parent_id string, kind string, number int", UNITS))
def article_unit_ids(spark: SparkSession, sf: str) -> DataFrame:
    return citing.article_units(laws_and_articles(spark)[1].where("no = '第77條'")).select("unit_id", "parent_id", "kind", "number")


@query(with_tables("SELECT 'A' AS law_id, '第77條' AS no, 'A/a:77/p:1/i:2' AS unit_id, substr(text, 19, 7) AS quote FROM articles WHERE no = '第77條'", "articles"))
def verified_unit(spark: SparkSession, sf: str) -> DataFrame:
    articles = laws_and_articles(spark)[1]
    return evidence.units_by_id(articles, citing.article_units(articles), ["A/a:77/p:1/i:2", "A/a:77/p:9"]).select("law_id", "no", "unit_id", "quote")


POINTS = "前言\n一、甲\n二、乙\n"
STRATEGY = [("sectioned-points", 3), ("parenthesized-points", 1), ("decimal-dom-list", 1), ("article-headings", 1)]


@query(values("strategy string, n int", STRATEGY))
def segmented_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of one text by each strategy; together they are the text."""
    row = spark.createDataFrame([(POINTS,)], "t string")
    out = [row.select(F.lit(s).alias("strategy"), segmenting.sections(F.col("t"), s).alias("p")).where(F.array_join(F.transform("p", lambda x: x["text"]), "") == F.col("t")).select("strategy", F.size("p").alias("n")) for s, _ in STRATEGY]
    return out[0].union(out[1]).union(out[2]).union(out[3])


HISTORY = [("1.中華民國二十七年\n  公布\n2.中華民國\n    修正", 2), ("", 0)]


@query(given("string", HISTORY, "int"))
def law_histories(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, "string", HISTORY, lambda v: F.size(segmenting.history_entries(v)))


BLOCKS = [("甲\n┌─┐\n└─┘\n乙", "text:0:2,table:2:10,text:10:11"), ("甲", "text:0:1"), ("", "")]


@query(given("string", BLOCKS))
def text_and_tables(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, "string", BLOCKS, lambda v: F.array_join(F.transform(segmenting.text_blocks(v), lambda b: F.concat_ws(":", b["kind"], b["start"].cast("string"), b["end"].cast("string"))), ","))


DRAWN = [("┌─┬─┐\n│甲│乙│\n└─┴─┘", "0:0:1:1:甲,0:1:1:1:乙"), ("┌──┬──┐\n│甲  │ab  │\n├──┤字字│\n│丙  │    │\n└──┴──┘", "0:0:1:1:甲  ,0:1:2:1:ab  \n字字\n    ,1:0:1:1:丙  "), ("┌─┬─┐\n│甲│乙\n└─┴─┘", None)]


@query(given("string", DRAWN))
def drawn_tables(spark: SparkSession, sf: str) -> DataFrame:
    cell = lambda c: F.concat_ws(":", *[c[k].cast("string") for k in ("row", "col", "rowspan", "colspan", "text")])
    return checked(spark, "string", DRAWN, lambda v: F.array_join(F.transform(tables.table_cells(v), cell), ","))


DEFINED = [("A", "建築物", "第2條"), ("B", "居室", "第2條"), ("B", "防火門", "第2條")]


@query(values("law_id string, term string, no string", DEFINED))
def defined_terms(spark: SparkSession, sf: str) -> DataFrame:
    laws, articles = fixture(spark, "laws"), fixture(spark, "articles")
    laws = laws.withColumn("name", F.when(F.col("id") == "B", "建築技術規則").otherwise(F.col("name")))  # so that 本規則 is its own name
    return citing.law_definitions(articles, laws).select("law_id", "term", "no")


USES = [("第1條", "依建築物管理條例辦理後，建築物之使用及居室。"), ("第3條", "┌─┐\n│居室│\n└─┘\n室內"), ("第4條", "居室與居室，建築物")]
USED = [("第1條", "建築物", 12, 15), ("第1條", "居室", 19, 21), ("第4條", "居室", 0, 2), ("第4條", "建築物", 6, 9)]


@query(values("no string, term string, start int, end_at int", USED))
def definition_uses(spark: SparkSession, sf: str) -> DataFrame:
    """First uses of terms outside longer law names and drawn tables."""
    articles = spark.createDataFrame([("L", no, t) for no, t in USES], "law_id string, no string, text string")
    defined = spark.createDataFrame([("L", "建築物", "第2條"), ("L", "居室", "第2條"), ("L", "室", "第2條")], "law_id string, term string, no string")
    return citing.definition_uses(articles, defined).where("term <> '室'").select("no", "term", "start", F.col("end").alias("end_at"))


CONTEXT = [("B", "本法", "A", "B", "alias"), ("C", "本法", "A", "B", "alias")]


@query(values("law_id string, alias string, alias_law string, source_law string, kind string", CONTEXT))
def citation_context(spark: SparkSession, sf: str) -> DataFrame:
    """本法 as the general part declares it, taken over by the other volume."""
    laws, articles = laws_and_articles(spark)
    return citing.citation_context(articles, laws)


CITED = [
    ("A", "第77-1條", "A", "77", "A/a:77/p:1/i:1", False), ("A", "第77-1條", "A", "77", "A/a:77/p:1/i:2", False), ("A", "第77-1條", "A", "2", "", False), ("B", "第1條", "A", "77", "", False),
    ("B", "第3條", "A", "1", "", False), ("B", "第3條", "A", "2", "", False), ("B", "第3條", "A", "77", "", False), ("B", "第3條", "A", "77-1", "", False), ("C", "第2條", "A", "77", "", True),
]


@query(values("law_id string, no string, target_law string, address string, unit string, fallback boolean", CITED))
def cited_units(spark: SparkSession, sf: str) -> DataFrame:
    """Citations down to the unit; parts that don't exist fall back to the article, unknown laws give none."""
    laws, articles = laws_and_articles(spark)
    texts = articles.select(F.concat_ws("|", "law_id", "no").alias("key"), "law_id", F.lit(0).alias("paragraph"), "text")
    found = citing.found_citations(texts, "key", laws, articles)
    counts = citing.unit_counts(citing.article_units(articles))
    rows = citing.resolved_units(found, articles, counts).select(F.split_part("key", F.lit("|"), F.lit(1)).alias("law_id"), F.split_part("key", F.lit("|"), F.lit(2)).alias("no"), "target_law", "address", "unit", "fallback")
    return rows.where("law_id <> 'C' or no <> '第1條'").distinct()


@query(values("law_id string, no string, article string, n_units long, fallback boolean", [("A", "第77-1條", "2", 0, False), ("A", "第77-1條", "77", 2, False)]))
def targets_by_article(spark: SparkSession, sf: str) -> DataFrame:
    rows = cited_units(spark, sf).where("law_id = 'A'").withColumnRenamed("address", "article")
    return reports.targets_by_article(rows, ["law_id", "no"]).select("law_id", "no", "article", "n_units", "fallback")


PATHS = [("第一項第二款", "p:1/i:2"), ("第二項", "p:2"), ("第一項第一款至第三款", "p:1/i:1,p:1/i:2,p:1/i:3"), ("第一款", "?"), ("第一項及第二項", "p:1,p:2"), ("第一項第二款第一目", "p:1/i:2/s:1"), ("第三項", "?"), ("第一項第三款至第一款", "?"), ("", "")]


@query(given("string", PATHS))
def unit_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Units of an article with two paragraphs, the first of three items, the second item with one subitem; ? where uncertain."""
    have = F.array(F.array(F.lit(0), F.lit(1), F.lit(0)), F.array().cast("array<int>"))
    shown = lambda t: F.array_join(F.transform(t, lambda x: F.when(x["fallback"], "?").otherwise(x["path"])), ",")
    return checked(spark, "string", PATHS, lambda v: shown(segmenting.unit_targets(v, have)))


# letters


LETTERS = [
    ("101", "內政部 84.3.5 台內營字第8412345號函", "8412345", "1995-03-05", "2024-01-02", "建築管理組", "使用與室內裝修", "mentioned", 1), ("102", "", "", "", "2024-01-02", "國土管理署", "農舍與農業設施", "unchecked", 1),
    ("103", "內政部 113年13月40日 營字第９８７６５４３２號令", "98765432", "", "", "下水道工程處", "下水道與設備", "unchecked", 0), ("105", "營建署 營字第98765432號函", "98765432", "", "", "國土管理署", "建築設計與管理", "unchecked", 0),
]


@query(values("id string, number string, number_key string, date string, published string, unit string, topic string, status string, n_links int", LETTERS))
def ruling_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rulings.ruling_rows(fixture(spark, "rulings")).select("id", "number", "number_key", "date", "published", "unit", "topic", "status", F.size("links").alias("n_links"))


@query(values("id string, body string", [("101", "依建築法第七十七條及第七十七條之一規定，停止適用。\n附件"), ("102", "請依建築法辦理，並依內政部第8412345號函。"), ("103", "甲\t建築法令彙編"), ("105", "同文")]))
def ruling_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return rulings.ruling_rows(fixture(spark, "rulings")).select("id", F.regexp_replace("body", "[ \t]*\t[ \t]*|(?<=甲) ", "\t").alias("body"))


REFS = [("101", "A", "第77條", "建築法第77條"), ("101", "A", "第77-1條", "建築法第77-1條"), ("102", "A", None, "建築法")]


@query(values("ruling string, law string, article string, evidence string", REFS))
def ruling_refs(spark: SparkSession, sf: str) -> DataFrame:
    laws, articles = laws_and_articles(spark)
    names = laws.select(F.col("name_norm").alias("name"), F.col("id").alias("law"))
    known = articles.select(F.col("law_id").alias("law"), "no", F.col("no_norm").alias("key"))
    return rulings.ruling_refs(rulings.ruling_rows(fixture(spark, "rulings")), names, known)


@query(values("key long, id long", [(102, 101)]))
def ruling_links(spark: SparkSession, sf: str) -> DataFrame:
    return rulings.ruling_links(rulings.ruling_rows(fixture(spark, "rulings")))


@query(with_tables("SELECT id, title, '' AS body, true AS summary_only FROM rulings", "rulings"))
def ruling_heads(spark: SparkSession, sf: str) -> DataFrame:
    return reports.summary_heads(fixture(spark, "rulings").withColumnRenamed("content", "body")).select("id", "title", "body", "summary_only")


# graph


def universe(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    laws = fixture(spark, "laws").select(F.concat(F.lit("l:"), "id").alias("id"), F.col("name").alias("label"), F.lit("law").alias("kind"), "region")
    letters = fixture(spark, "rulings").select(F.concat(F.lit("r:"), "id").alias("id"), F.col("title").alias("label"), F.lit("ruling").alias("kind"), F.lit("函釋").alias("region"))
    nodes = laws.union(letters)
    return nodes, graph.universe_edges(fixture(spark, "relations"), fixture(spark, "referred"), fixture(spark, "cited"), nodes)


_EDGES = """e AS (SELECT 'l:' || parent AS f, 'l:' || child AS t, 'basis' AS kind FROM relations WHERE parent IN (SELECT id FROM laws) AND child IN (SELECT id FROM laws)
UNION ALL SELECT DISTINCT 'r:' || ruling, 'l:' || law, 'reference' FROM referred WHERE law IN (SELECT id FROM laws) UNION ALL SELECT DISTINCT 'r:' || ruling, 'r:' || cited, 'citation' FROM cited WHERE ruling <> cited AND cited IN (SELECT id FROM rulings))"""
_GRAPH = with_tables("", "laws", "rulings", "relations", "referred", "cited").rstrip() + ", " + _EDGES


@query(_GRAPH + " SELECT f AS from_node, t AS to_node, kind FROM e")
def universe_edges(spark: SparkSession, sf: str) -> DataFrame:
    return universe(spark)[1].toDF("from_node", "to_node", "kind")


@query(_GRAPH + " SELECT kind, count(*) AS n FROM e GROUP BY kind")
def edge_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edge_counts(universe(spark)[1])


@query(values("asked string, node string", [("l:B", "l:B"), ("l:B", "l:C"), ("l:B", "l:A"), ("l:B", "r:101"), ("l:B", "r:102"), ("r:101", "r:101"), ("r:101", "l:A"), ("r:101", "r:102"), ("r:101", "r:103")]))
def graph_focus(spark: SparkSession, sf: str) -> DataFrame:
    edges = universe(spark)[1]
    return graph.focus(edges, "l:B").select(F.lit("l:B").alias("asked"), "node").union(graph.focus(edges, "r:101").select(F.lit("r:101"), "node"))


@query(with_tables("SELECT DISTINCT parent AS node FROM relations WHERE child = 'A'", "relations"))
def graph_parents(spark: SparkSession, sf: str) -> DataFrame:
    return graph.ancestors(fixture(spark, "relations").toDF("from", "to"), "A")


@query(with_tables("SELECT 'l:' || laws.id AS id, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(degree, 0) AS degree FROM laws LEFT JOIN places ON places.id = 'l:' || laws.id", "laws", "places"))
def node_places(spark: SparkSession, sf: str) -> DataFrame:
    nodes = fixture(spark, "laws").select(F.concat(F.lit("l:"), "id").alias("id"))
    return graph.with_places(nodes, fixture(spark, "places"))


def fnv(value: str) -> str:
    """The hash fraction of an ASCII text, in SQL."""
    return f"(SELECT CAST(list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split({value}, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS DOUBLE) / 4294967296)"


@query(with_tables(f"""SELECT id, round(x - 185, 6) AS x, round(y - 4, 6) AS y, round(430 * (0.18 * sin((x - 185) / 430 * 5.2) + 0.12 * cos((y - 4) / 430 * 5.8) + ({fnv('id')} - 0.5) * 0.31), 6) AS z FROM places""", "places"))
def node_space(spark: SparkSession, sf: str) -> DataFrame:
    return graph.in_space(fixture(spark, "places")).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("z", 6).alias("z"))


@query(with_tables(f"""SELECT r.id, round(CASE WHEN m.x IS NOT NULL THEN m.x + cos(2 * pi() * {fnv('r.id')}) * (50 + 185 * {fnv("r.id || 'r'")}) ELSE cos(2 * pi() * {fnv('r.id')}) * (1000 + 300 * {fnv("r.id || 'ring'")}) END, 6) AS x,
round(CASE WHEN m.x IS NOT NULL THEN m.y + sin(2 * pi() * {fnv('r.id')}) * (50 + 185 * {fnv("r.id || 'r'")}) ELSE sin(2 * pi() * {fnv('r.id')}) * (1000 + 300 * {fnv("r.id || 'ring'")}) * 0.8 END, 6) AS y
FROM rulings r LEFT JOIN (SELECT ruling, avg(x) AS x, avg(y) AS y FROM (SELECT DISTINCT ruling, law FROM referred) d JOIN places ON places.id = 'l:' || law GROUP BY ruling) m ON m.ruling = r.id""", "rulings", "referred", "places"))
def ruling_places(spark: SparkSession, sf: str) -> DataFrame:
    places = fixture(spark, "places").withColumn("law", F.substr("id", F.lit(3)))
    return graph.placed_rulings(fixture(spark, "rulings"), fixture(spark, "referred"), places).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(values("asked int, id string", [(0, "b"), (1, "d"), (2, "e")]))
def picked_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The frontmost visible disc; outside of all discs the nearest for its margin."""
    points = fixture(spark, "screen")
    asked = [graph.picked(points, x, 0.0).select(F.lit(i).alias("asked"), "id") for i, x in enumerate((0.5, 43.5, 49.0, 500.0))]
    return asked[0].union(asked[1]).union(asked[2]).union(asked[3])


@query(values("id string", [("l:F",), ("r:101",)]))
def found_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes, laws = universe(spark)[0], fixture(spark, "laws")
    return reading.found_nodes(nodes, laws, "防火門").union(reading.found_nodes(nodes, laws, "室 內裝")).select("id")


# reports


@query(with_tables("""SELECT id, 'uncovered' AS error FROM held_before WHERE id NOT IN (SELECT id FROM outcomes) UNION ALL SELECT id, 'duplicate' FROM outcomes GROUP BY id HAVING count(*) > 1
UNION ALL SELECT DISTINCT id, 'invalid-status' FROM outcomes WHERE status NOT IN ('updated', 'unchanged', 'retained', 'not-attempted', 'unavailable')
UNION ALL SELECT DISTINCT o.id, 'invented-fetch' FROM outcomes o LEFT JOIN held_after a USING (id) WHERE o.last_fetch <> coalesce(a.retrieved, '')
UNION ALL SELECT DISTINCT o.id, 'retained-changed' FROM outcomes o LEFT JOIN held_before b USING (id) LEFT JOIN held_after a USING (id) WHERE status IN ('retained', 'not-attempted') AND (b.hash IS NULL OR b.hash IS DISTINCT FROM a.hash OR b.source_hash IS DISTINCT FROM a.source_hash)
UNION ALL SELECT DISTINCT o.id, 'unavailable-present' FROM outcomes o LEFT JOIN held_before b USING (id) LEFT JOIN held_after a USING (id) WHERE status = 'unavailable' AND (b.hash IS NOT NULL OR a.hash IS NOT NULL)
UNION ALL SELECT DISTINCT id, 'no-attempt' FROM outcomes WHERE status IN ('updated', 'unchanged') AND attempted_at = ''""", "outcomes", "held_before", "held_after"))
def outcome_errors(spark: SparkSession, sf: str) -> DataFrame:
    return reports.outcome_errors(fixture(spark, "outcomes"), fixture(spark, "held_before"), fixture(spark, "held_after"))


FAILURE = "array<struct<name:string,url:string,reason:string>>"
REPORT_ERRORS = [("b", "other-run", ""), ("b", "incomplete", ""), ("b", "missing-field", "checks"), ("b", "fatal", "boom"), ("b", "missing-law", "甲法"), ("b", "failed-source", "u：404"), ("b", "failed-source", "乙：來源失敗")]


@query(values("run string, error string, detail string", REPORT_ERRORS))
def report_errors(spark: SparkSession, sf: str) -> DataFrame:
    rows = [("a", "r1", "complete", None, [], [], [], ["ok"]), ("b", "r2", "running", "boom", ["甲法"], [(None, "u", "404")], [("乙", None, None)], None)]
    report = spark.createDataFrame(rows, f"run string, run_id string, status string, fatal string, missing_central array<string>, local_failures {FAILURE}, central_failures {FAILURE}, checks array<string>")
    return reports.report_errors(report, "r1")


CANDIDATES = [("A", ""), ("B", "changed-identity unofficial-url"), ("C", "no-source-hash fetch-time duplicate-numbers empty-article"), ("D", "contaminated lost-articles shrunk"), ("N", "empty-full-text")]


@query(values("id string, broken string", CANDIDATES))
def checked_candidates(spark: SparkSession, sf: str) -> DataFrame:
    columns = "id string, name string, region string, source string, url string, coverage string, retrieved string"
    rows = [(i, n, "中央", "s", f"https://law.gov.tw/{i}", "full", "t") for i, n in (("A", "甲"), ("B", "乙"), ("C", "丙"), ("D", "丁"))]
    old = spark.createDataFrame(rows, columns)
    new = spark.createDataFrame([rows[0], ("B", "乙乙", "中央", "s", "http://law.gov.tw/B", "full", "t"), rows[2], rows[3], ("N", "新", "中央", "s", "https://laws.gov.taipei/N", "full", "t")], columns)
    article = "law_id string, no string, text string"
    old_articles = spark.createDataFrame([(i, f"第{k}條", "十個字十個字十個字十") for i in "ABCD" for k in (1, 2)], article)
    new_articles = spark.createDataFrame([(i, f"第{k}條", "十個字十個字十個字十") for i in "AB" for k in (1, 2)] + [("C", "第1條", "十個字十個字十個字十"), ("C", "第 1 條", " "), ("C", "第2條", "十個字十個字十個字十"), ("D", "第1條", "<script")], article)
    sources = spark.createDataFrame([(i, "a" * 64, "t") for i in "ABDN"], "id string, sha256 string, observed_at string")
    return reports.checked_candidates(new, new_articles, sources, old, old_articles).select("id", F.array_join("reasons", " ").alias("broken"))


@query(with_tables("""SELECT id, '官方來源' AS label, CASE WHEN source = '' THEN '未提供來源名稱' ELSE source END AS value FROM laws UNION ALL SELECT id, '來源所載生效日期', CASE WHEN effective LIKE '9999%' THEN '依官方生效說明' WHEN effective = '' THEN '未另列；請查條文與沿革' ELSE effective END FROM laws
UNION ALL SELECT laws.id, '本次同步結果', CASE status WHEN 'updated' THEN '本次來源已取得；資料已更新' WHEN 'retained' THEN '本次未能更新；保留原快照' END FROM laws JOIN outcomes USING (id) WHERE id IN ('A', 'B') UNION ALL SELECT id, '官方再次核對', '尚未載入逐筆官方再核對紀錄' FROM laws WHERE id NOT IN ('A', 'B')
UNION ALL SELECT id, '原始文件 SHA-256', doc_sha256 FROM laws WHERE doc_sha256 IS NOT NULL""", "laws", "outcomes"))
def version_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.version_rows(fixture(spark, "laws"), fixture(spark, "outcomes").where("id in ('A', 'B')"))
    return rows.where(F.col("label").isin("官方來源", "來源所載生效日期", "本次同步結果", "官方再次核對", "原始文件 SHA-256")).select("id", "label", "value")


@query(with_tables("SELECT laws.id, CASE o.status WHEN 'updated' THEN '本次來源已取得；資料已更新' WHEN 'retained' THEN '本次未能更新；保留原快照' WHEN 'unavailable' THEN '本次來源未取得；無可用快照' END AS outcome, o.reason AS outcome_reason FROM laws LEFT JOIN (SELECT * FROM outcomes WHERE id < 'F') o USING (id)", "laws", "outcomes"))
def sync_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return reports.outcome_of(fixture(spark, "laws"), fixture(spark, "outcomes").where("id < 'F'")).select("id", "outcome", "outcome_reason")


_HOLD = "count(*) FILTER (coverage = 'full') AS n_full, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_articles, count(*) FILTER (has_document) AS n_documents, count(*) FILTER (coverage = 'link' AND NOT has_document) AS n_links FROM laws LEFT JOIN (SELECT law_id AS id, count(*) AS n FROM articles GROUP BY 1) a USING (id)"


@query(with_tables(f"SELECT region, CAST(1 AS INT) AS level, {_HOLD} GROUP BY region UNION ALL SELECT NULL, 0, {_HOLD}", "laws", "articles"))
def region_holdings(spark: SparkSession, sf: str) -> DataFrame:
    return reports.holdings(reports.slim_catalog(fixture(spark, "laws"), fixture(spark, "articles")))


@query(with_tables("SELECT laws.id, laws.name, coalesce(n, 0) AS n_articles FROM laws LEFT JOIN (SELECT law_id AS id, count(*) AS n FROM articles GROUP BY 1) a USING (id)", "laws", "articles"))
def slim_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return reports.slim_catalog(fixture(spark, "laws"), fixture(spark, "articles")).select("id", "name", "n_articles")


@query(values("id string, n_folders int, n_entries int", [("x", 2, 3), ("y", 0, 0)]))
def casebook_totals(spark: SparkSession, sf: str) -> DataFrame:
    books = spark.createDataFrame([("x", [([1, 2],), ([3],)]), ("y", [])], "id string, folders array<struct<entries:array<int>>>")
    return reports.entries_of(books)


@query(with_tables("SELECT id, content_hash, source_hash, observed_at FROM evidence", "evidence"))
def evidence_versions(spark: SparkSession, sf: str) -> DataFrame:
    return reports.evidence_version(fixture(spark, "evidence"))


@query(values("title string, article string, format string, known boolean", [("第 3-1 條補充圖例.PDF", "3-1", "PDF", True), ("第 1 條補充圖例圖1-3-(8).JPG", "1", "JPG", True), ("補充圖例總表", None, None, False)]))
def attachment_articles(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = reports.attachment_articles(fixture(spark, "attachments"))
    return good.select("title", "article", "format", F.lit(True).alias("known")).unionByName(bad.select("title", F.lit(None).cast("string").alias("article"), F.lit(None).cast("string").alias("format"), F.lit(False).alias("known")))


# search over laws, articles, pages and letters


@query(values("law_id string, no string", [("A", None), ("A", "第77條"), ("B", "第1條"), ("B", "第3條"), ("C", "第2條")]))
def law_search(spark: SparkSession, sf: str) -> DataFrame:
    laws, articles = laws_and_articles(spark)
    hits = search.search(laws, articles, compile_query("建築法", VOCABULARY), VOCABULARY).select("law_id", "no")
    return hits.union(search.search(laws, articles, compile_query("建築法第七十七條", VOCABULARY), VOCABULARY).select("law_id", "no"))


_TOPICAL = [("X", "第1條", 2), ("X", "第2條", 1)]


@query(values("law_id string, no string, place int", _TOPICAL))
def topics_by_law(spark: SparkSession, sf: str) -> DataFrame:
    """A city in the query names the law's place, so it is no topic: the article that deals with 採光 from its first word leads, not the one with both words."""
    laws = spark.createDataFrame([("X", 0, "某條例", "臺北市", ["k"])], "id string, ord int, name string, region string, keywords_norm array<string>").select("*", F.col("name").alias("name_norm"), F.col("region").alias("region_norm"), F.lower("id").alias("id_norm"))
    articles = spark.createDataFrame([("X", 0, "第1條", "臺北市採光"), ("X", 1, "第2條", "採光採光採光")], "law_id string, ord int, no string, text string").select("*", F.col("no").alias("no_norm"), F.col("text").alias("body_norm"))
    rows = [(r["law_id"], r["no"]) for r in search.search(laws, articles, compile_query("臺北市 採光"), Vocabulary()).collect()]  # two hits; their order is the result
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows, 1)], "law_id string, no string, place int")


@query(with_tables("SELECT law_id, no, CAST(CASE WHEN contains(text, '防火設施') THEN 2 WHEN contains(text, '防火') AND contains(text, '設施') THEN 1 ELSE 0 END AS INT) AS score FROM articles", "articles"))
def partial_terms(spark: SparkSession, sf: str) -> DataFrame:
    """A term made of known words: 1 where only its words occur."""
    term = compile_query("防火設施", VOCABULARY).terms[0]
    return fixture(spark, "articles").select("law_id", "no", search.term_score(term, [F.col("text")]).alias("score"))


DEFINES = ["建築物:指定著於土地之構造物。", "本法所稱,建築物及構造物。", "附表;構造物,係指建築物之部分。建築物", "無關"]
_ONE = "(CASE WHEN strpos(t, '建築物') > 0 THEN 15 + 10 * (n / (n + 1.2 * (0.25 + 0.75 * length(t) / 400))) + lead + def ELSE 0 END)"


@query(f"""SELECT t, round(34 * (1 - exp(-{_ONE} / 40)), 6) AS relevance FROM (SELECT t, (length(t) - length(replace(t, '建築物', ''))) / 3 AS n, lead, def FROM (VALUES {', '.join(f"('{t}', {lead}, {d})" for t, lead, d in zip(DEFINES, ("30.0", "15 * (1 - 5 / 90.0)", "15 * (1 - 9 / 90.0)", "0.0"), ("100.0", "0.0", "0.0", "0.0"), strict=True))}) v(t, lead, def))""")
def defined_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """A text that defines the word counts more than one that mentions it, even in another word's definition."""
    rows = spark.createDataFrame([(t,) for t in DEFINES], "t string")
    return rows.select("t", F.round(search.relevance(F.col("t"), [["建築物"]]), 6).alias("relevance"))


PAGE_HITS = [("F", 1, 150.0, "phrase", "防 火 門之檢查"), ("F", 3, 150.0, "phrase", "ＦＩＲＥ 門 及防火門設備之維護與檢查")]


@query(values("law_id string, page int, score double, match string, excerpt string", PAGE_HITS))
def page_search(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose normal form holds the words; excerpts come from the page as it is."""
    laws, _ = laws_and_articles(spark)
    pages = fixture(spark, "doc_pages").withColumn("body_norm", normalized("text"))
    return search.search_documents(laws.withColumn("name_norm", F.lit("手冊")).withColumn("keywords_norm", F.array().cast("array<string>")), pages, compile_query("防火門", VOCABULARY)).select("law_id", "page", "score", "match", "excerpt")


EXCERPTS = [("一 二 三 " * 30 + "防 火 門" + "x" * 300, 90, "…" + ("一 二 三 " * 30 + "防 火 門" + "x" * 300)[154:374] + "…"), ("ﬁre 門", 4, "ﬁre 門")]


@query(values("text string, place int, excerpt string", EXCERPTS))
def page_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    """A place in the normal form is found again in the page itself."""
    rows = spark.createDataFrame([e[:2] for e in EXCERPTS], "text string, place int")
    return rows.select("text", "place", search.page_excerpts(F.col("text"), F.col("place")).alias("excerpt"))


@query(values("law_id string, no string, page int, type string", [("F", None, None, "laws"), ("B", "第2條", None, "articles"), ("A", "第77-1條", None, "articles"), ("F", None, 1, "documents"), ("F", None, 2, "documents"), ("F", None, 3, "documents")]))
def indexed_search(spark: SparkSession, sf: str) -> DataFrame:
    """Laws, articles and pages in one result, read through the index."""
    laws, articles = laws_and_articles(spark)
    pages = fixture(spark, "doc_pages").withColumn("body_norm", normalized("text"))
    heads = laws.select(F.col("id").alias("law_id"), *[F.col(c).alias(f"h_{c}") for c in ("name_norm", "region_norm", "id_norm")], F.array_join("keywords_norm", "\n").alias("h_keywords"))
    fields = [F.col("body_norm"), F.col("h_name_norm"), F.col("h_region_norm"), F.col("h_id_norm"), F.col("h_keywords")]
    by_article = search.postings(articles.join(heads, "law_id"), ["law_id", "no"], fields)
    by_page = search.postings(pages.join(heads, "law_id"), ["law_id", "page"], fields)
    hits = search.indexed_search(laws, articles, pages, by_article, by_page, compile_query("防火", VOCABULARY), VOCABULARY)
    return hits.select("law_id", "no", "page", "type")


@query(values("id string, score int", [("101", 1020), ("105", 0)]))
def indexed_rulings(spark: SparkSession, sf: str) -> DataFrame:
    """A letter's number, and one asked for by words; 0 marks the second query."""
    rows = rulings.ruling_rows(fixture(spark, "rulings"))
    rows = rows.select("id", F.col("id").cast("int").alias("ord"), normalized("number").alias("number_norm"), "number_key", normalized("title").alias("title_norm"), normalized("body").alias("body_norm"), normalized("topic").alias("topic_norm"), normalized("unit").alias("unit_norm"), F.array().cast("array<struct<law:string,article_norm:string,evidence_norm:string>>").alias("refs"))
    index = search.postings(rows, ["id"], [F.col(c) for c in ("number_norm", "number_key", "title_norm", "body_norm", "topic_norm", "unit_norm")])
    first = search.indexed_rulings(rows, index, compile_query("8412345"), VOCABULARY).where("score >= 1000").select("id", "score")
    return first.union(search.indexed_rulings(rows, index, compile_query("同文"), VOCABULARY).select("id", F.lit(0)))


@query(values("id string, place int", [("3", 1), ("1", 2), ("2", 3), ("4", 4)]))
def rulings_by_date(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([("1", 0, 20, "2020-01-01", ""), ("2", 1, 20, "", "2019-05-05"), ("3", 2, 120, "1990-01-01", ""), ("4", 3, 20, "", "")], "id string, ord int, score int, date string, published string")
    ids = [r["id"] for r in search.recent_rulings_first(rows).collect()]  # four rows; their order is the result
    return spark.createDataFrame([(x, i) for i, x in enumerate(ids, 1)], "id string, place int")


@query(values("law_id string, part string, rank int", [("X", "1", 1), ("Y", "1", 2), ("X", "2", 1)]))
def supplemented_hits(spark: SparkSession, sf: str) -> DataFrame:
    """More hits of laws already found, each part once; no new law."""
    schema = "law_id string, part string, rank int"
    hits = spark.createDataFrame([("X", "1", 1), ("Y", "1", 2)], schema)
    more = spark.createDataFrame([("X", "2", 1), ("X", "1", 2), ("Z", "1", 3)], schema)
    return search.with_supplement(hits, more, "law_id", "part", "rank")


@query(values("law_id string, kept string", [("A", "0:2,5:7"), ("B", "1:4")]))
def greedy_spans(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([("A", [(0, 2), (1, 6), (5, 7)]), ("B", [(1, 4), (3, 9)])], "law_id string, spans array<struct<start:int,end:int>>")
    return rows.select("law_id", F.array_join(F.transform(joins.greedy_disjoint(F.col("spans")), lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("kept"))


def normalized(column: str):
    return text.normalize(column)
