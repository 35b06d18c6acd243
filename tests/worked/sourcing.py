"""Worked examples of sources and what is made of them: feeds, site pages, shards, versions, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import citing, evidence, reports, search
from tests.worked.fixtures import fixture, laws_and_articles, values, with_tables
from tests.worked.registry import query
from quern.sinks import tables
from quern.sinks.scratch import new_folder
from quern.sources import records, rulings, sites

LAW = "<Law><LawLevel>法律</LawLevel><LawName>{name}</LawName><LawURL>https://law.moj.gov.tw/LawClass/LawAll.aspx?pcode={code}</LawURL><LawAbandonNote>{gone}</LawAbandonNote>{rest}</Law>"
BODY = "<LawAttachements><File><FileName>表一</FileName><FileURL>u1</FileURL></File></LawAttachements><LawArticles>{}</LawArticles>"
ARTICLE = "<Article><ArticleType>{}</ArticleType><ArticleNo>{}</ArticleNo><{tag}>{}</{tag}></Article>"
FEED = "<Laws>" + "".join(
    [
        LAW.format(name="建築法", code="D0070109", gone="", rest=BODY.format("".join([ARTICLE.format("C", "", "第一章  總則", tag="ArticleConctent"), ARTICLE.format("A", "第 1 條", "為實施管理。", tag="ArticleConctent"), ARTICLE.format("C", "", "第二章 許可", tag="ArticleConctent"), ARTICLE.format("C", "", "第一節 申請", tag="ArticleConctent"), ARTICLE.format("A", "第 2 條", " 申請。", tag="ArticleContent")]))),
        LAW.format(name="舊法", code="D0070001", gone="廢", rest=BODY.format(ARTICLE.format("A", "第 1 條", "舊。", tag="ArticleContent"))),
        LAW.format(name="已有法", code="D0070002", gone="", rest=BODY.format("")),
        "<Law><LawArticles/></Law>",
    ]
) + "</Laws>"


def feed(spark: SparkSession) -> DataFrame:
    path = new_folder(spark, "feed")
    spark.createDataFrame([(FEED,)], "value string").coalesce(1).write.text(path)
    return records.xml_laws(spark, path)[0]


@query(values("name string, no string, text string, path array<string>", [("建築法", "第 1 條", "為實施管理。", ["第一章 總則"]), ("建築法", "第 2 條", "申請。", ["第二章 許可", "第一節 申請"]), ("舊法", "第 1 條", "舊。", [])]))
def feed_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of a feed with the headings above them, in either spelling of its text element."""
    return records.xml_law_texts(feed(spark)).select(F.col("LawName").alias("name"), "no", "text", "path")


@query(values("name string, title string, url string", [("建築法", "表一", "u1"), ("舊法", "表一", "u1"), ("已有法", "表一", "u1")]))
def feed_attachments(spark: SparkSession, sf: str) -> DataFrame:
    return records.xml_attachments(feed(spark)).withColumnRenamed("LawName", "name")


@query(values("name string, code string", [("建築法", "D0070109")]))
def current_feed_laws(spark: SparkSession, sf: str) -> DataFrame:
    wanted = spark.createDataFrame([("建築法",), ("舊法",), ("已有法",)], "name string")
    present = spark.createDataFrame([("D0070002",)], "id string")
    return records.current_laws(feed(spark), wanted, present).select(F.col("LawName").alias("name"), "code")


def body(html: str) -> str:
    return f'<div id="ctl00_divLawContent08">{html}</div>'


PAGES = [
    ("rows", "rows", '<div id="pnLawFla"><div class="law-reg-content"><div class="h3 char-2">第 一 章 總則</div><div class="row"><div class="col-no"><a href="LawSingle.aspx">第 1 條</a></div><div class="col-data"><div class="law-article"><div class="line-0000">甲</div><div class="line-0004">乙</div></div></div></div></div></div>'),
    ("list", "list", '<ul class="law law-content"><li class="chapter"> 第一章 總則<li><div class="col-no">第 1 條</div><div class="law-articlepre">甲<br>乙</div></li><li><div class="law-articlepre">二、丙</div></li></ul>'),
    ("columns", "columns", '<table><tr><td class="col-th">1</td><td class="col-td"><pre>甲</pre></td></tr><tr><td class="col-th">第 2 條</td><td class="col-td"><pre>乙</pre></td></tr></table>'),
    ("table", "table", '<table id="x_tableLawArticle"><tr><td colspan=2>第一章 總則<tr><td>第 1 條<td>甲<tr><td>三、<td>乙<tr><td><td>第 4 條 丙</table>'),
    ("headings", "headings", body("第一章 總則<br>第 1 條 甲<br>依第 9 條<br>第 2 條<br>乙")),
    ("points", "headings", body("<p>一、甲</p><p>二之一、乙</p>")),
    ("bold", "bold-article-headings", body("<b>第 1 條</b><p>甲</p><b>第 2 條</b>乙")),
    ("ordered", "decimal-dom-list", body("<ol><li>甲<ol><li>子</li><li>丑</li></ol></li><li>乙</li></ol>")),
    ("files", "attachment-only", body("名稱") + '<a href="Download.ashx?1">附件</a>'),
    ("broken", "bold-article-headings", body("前言<b>第 1 條</b>甲")),
    ("twice", "columns", '<tr><td class="col-th">第 1 條</td><td class="col-td">甲</td></tr><tr><td class="col-th">第1條</td><td class="col-td">乙</td></tr>'),
    ("none", "rows", "<p>無</p>"),
]
READ = [
    ("rows", 0, "第 1 條", "甲\n乙", "第 一 章 總則"), ("list", 0, "第 1 條", "甲\n乙", "第一章 總則"), ("list", 1, "第二點", "丙", "第一章 總則"), ("columns", 0, "第 1 點", "甲", ""), ("columns", 1, "第 2 條", "乙", ""),
    ("table", 0, "第 1 條", "甲", "第一章 總則"), ("table", 1, "第三點", "乙", "第一章 總則"), ("table", 2, "第 4 條", "丙", "第一章 總則"), ("headings", 0, "第 1 條", "甲\n依第 9 條", "第一章 總則"), ("headings", 1, "第 2 條", "乙", "第一章 總則"),
    ("points", 0, "第一點", "甲", ""), ("points", 1, "第二之一點", "乙", ""), ("bold", 0, "第 1 條", "甲", ""), ("bold", 1, "第 2 條", "乙", ""), ("ordered", 0, "第1點", "甲\n  1. 子\n  2. 丑", ""), ("ordered", 1, "第2點", "乙", ""),
]


def site_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAGES, "id string, layout string, html string")


@query(values("id string, ord int, no string, text string, heads string", READ))
def site_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of law sites by their layout."""
    good, _ = sites.site_articles(site_pages(spark), "id", "html", F.col("layout"))
    return good.select("id", "ord", "no", "text", F.array_join("path", "/").alias("heads"))


@query(values("id string, error string", [("broken", "text before the first heading"), ("twice", "repeated number"), ("none", "no articles")]))
def unread_pages(spark: SparkSession, sf: str) -> DataFrame:
    return sites.site_articles(site_pages(spark), "id", "html", F.col("layout"))[1]


@query(values("id string, title string, url string", [("files", "附件", "Download.ashx?1")]))
def page_files(spark: SparkSession, sf: str) -> DataFrame:
    return site_pages(spark).select("id", F.explode(sites.page_attachments("html")).alias("f")).select("id", "f.title", "f.url")


HISTORY = [('<div class="law-history"><div class="text-pre">1.  公布<a>連</a></div><div class="text-pre">2.修正</div></div>', "1. 公布連\n2.修正"), ("<p>x</p>", None)]


@query(values("html string, history string", HISTORY))
def page_histories(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([h[:1] for h in HISTORY], "html string").select("html", sites.page_history("html").alias("history"))


SAFE = [('<p onclick="x">甲<script>bad()</script><a href="u">乙&amp;</a><td rowspan="2" style="s">丙', '<p>甲乙&amp;<td rowspan="2">丙</td></p>'), ("<br><iframe>x</iframe>", "<br>")]


@query(values("html string, safe string", SAFE))
def sanitised_pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([h[:1] for h in SAFE], "html string").select("html", sites.safe_html("html").alias("safe"))


@query(values("file string, data string, reason string", [("a.json", "甲", None), ("b.json", None, "different"), ("c.json", None, "missing")]))
def verified_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a manifest: read where the digest is right, told apart where not."""
    path = new_folder(spark, "shards")
    rows = spark.createDataFrame([('{"name":"甲"}', "a"), ('{"name":"乙"}', "b")], "value string, name string")
    for name in ("a", "b"):
        rows.where(F.col("name") == name).select("value").coalesce(1).write.text(f"{path}/{name}")
    held = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).select("path", F.sha2("content", 256).alias("sha256"))
    known = held.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.element_at(F.split("path", "/"), -2).alias("name"), "sha256")
    listed = known.select("file", "name", F.when(F.col("name") == "a", F.col("sha256")).otherwise("0").alias("sha256")).unionByName(spark.createDataFrame([("c.json", "c", "0")], "file string, name string, sha256 string"))
    good, bad = records.verified_shards(spark, f"{path}/*/part-*", listed, "name string")
    both = good.select("file", F.col("data.name").alias("data"), F.lit(None).cast("string").alias("reason")).unionByName(bad.select("file", F.lit(None).cast("string").alias("data"), "reason"))
    return both.join(listed.select("file", "name"), "file").select(F.concat("name", F.lit(".json")).alias("file"), "data", "reason")


@query(values("folder_id string, html string", [("f", '<!doctype html><meta charset="utf-8"><title>案&lt;1&gt;</title><h1>案&lt;1&gt;</h1><section><h2>甲</h2><blockquote>引&amp;文</blockquote></section><section><h2>乙</h2><blockquote>x</blockquote><p>註</p></section>')]))
def casebook_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([("f", "案<1>", 1, "乙", "x", "註"), ("f", "案<1>", 0, "甲", "引&文", None)], "folder_id string, folder string, ord int, title string, quote string, note string")
    return tables.casebook_html(rows)


@query(with_tables("SELECT id, list_concat([name, region, lower(id)], keywords) AS fields FROM laws", "laws"))
def law_search_fields(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.search_fields(fixture(spark, "laws"))


@query(values("id string, previous_hash string, observed_at string, source_hash string", [("A", "p", "2026", "s1"), ("B", "old", None, "bulk"), ("C", None, None, None)]))
def enriched_laws(spark: SparkSession, sf: str) -> DataFrame:
    """Versions from the ledger, where the content is still what was observed; sources by id, else by bulk file."""
    laws = spark.createDataFrame([("A", "甲", "CF"), ("B", "乙", "CF"), ("C", "丙", "CM")], "id string, name string, bulk_key string")
    now = laws.select("id", F.sha2(F.to_json(F.struct("id", "name")), 256).alias("h"))
    ledger = now.where("id <> 'C'").select("id", F.when(F.col("id") == "A", F.col("h")).otherwise("old").alias("content_hash"), F.lit("p").alias("previous_hash"), F.lit("2026").alias("observed_at"))
    sources = spark.createDataFrame([("A", "s1"), ("CF", "bulk")], "key string, sha256 string")
    return evidence.enriched_laws(laws, ledger, sources).select("id", "previous_hash", "observed_at", "source_hash")


@query(with_tables("SELECT 'e1' AS id, sha256(text) AS content_hash, 's' AS source_hash FROM articles WHERE law_id = 'A' AND no = '第2條' UNION ALL SELECT 'e2', sha256(substr(text, 19, 7)), 's' FROM articles WHERE no = '第77條' UNION ALL SELECT 'e3', sha256('同文'), NULL UNION ALL SELECT 'e4', sha256(text), 'd' FROM doc_pages WHERE law_id = 'F' AND page = 2", "articles", "doc_pages"))
def current_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Saved places of four kinds with what stands there now; one is gone."""
    schema = "id string, kind string, law string, article string, unit string, ruling string, page int"
    saved = spark.createDataFrame([("e1", "article", "A", "第2條", None, None, None), ("e2", "article", "A", "第77條", "A/a:77/p:1/i:2", None, None), ("e3", "ruling", None, None, None, "105", None), ("e4", "document", "F", None, None, None, 2), ("e5", "article", "A", "第9條", None, None, None)], schema)
    articles = laws_and_articles(spark)[1].withColumn("source_hash", F.lit("s"))
    units = evidence.units_by_id(articles, citing.article_units(articles), ["A/a:77/p:1/i:2"])
    pages = fixture(spark, "doc_pages").withColumn("source_hash", F.lit("d"))
    return evidence.current_texts(saved, articles, units, rulings.ruling_rows(fixture(spark, "rulings")), pages)


@query(with_tables("SELECT law_id, count(*) AS n, count(DISTINCT no) AS n_distinct, CAST(sum(length(regexp_replace(text, '\\s+', '', 'g'))) AS BIGINT) AS size FROM articles GROUP BY law_id", "articles"))
def article_facts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.article_facts(fixture(spark, "articles")).select("law_id", "n", "n_distinct", "size")


@query(values("id string, text string", [("x", "二\n三")]))
def page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.createDataFrame([("x", p, t, 2, 3) for p, t in ((3, "三"), (1, "一"), (2, "二"))], "id string, page int, text string, first int, last int")
    return records.page_range(pages, "id", "first", "last")


@query(values("id string, reason string", [("a", None), ("b", "source-changed"), ("c", "unknown-source")]))
def guarded_items(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.createDataFrame([("a", "s", "1"), ("b", "s", "2"), ("c", "t", "1")], "id string, source string, digest string")
    good, bad = records.guarded(items, spark.createDataFrame([("s", "1")], "source string, digest string"), "source", "digest")
    return good.select("id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("id", "reason"))


@query(values("id string, gap string", [("x", "多餘"), ("y", "第一章總則")]))
def unexplained_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """What parsed articles leave over must be a heading of that text."""
    found = spark.createDataFrame([("x", "第一章  總則\n"), ("x", "多餘"), ("x", " \n"), ("y", "第一章總則")], "id string, gap string")
    return evidence.unexplained_gaps(found, spark.createDataFrame([("x", "第一章 總則")], "id string, heading string"), "id")


@query(with_tables("SELECT 'catalog' AS name, count(*) AS n FROM laws UNION ALL SELECT 'targets', count(*) FROM articles WHERE text <> '' UNION ALL SELECT 'context', 1", "laws", "articles"))
def runtime_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue without texts, the units that can be cited, and what short names mean where another law says it."""
    laws, articles = laws_and_articles(spark)
    context = evidence.outside_only(citing.citation_context(articles, laws))
    catalog = reports.slim_catalog(fixture(spark, "laws"), fixture(spark, "articles"))
    return tables.write_runtime(new_folder(spark, "runtime"), catalog=catalog, targets=citing.unit_counts(citing.article_units(articles)), context=context)


LINES = [(1, "第一章 總則"), (2, "本手冊說明"), (3, "防火門。"), (4, "第二句"), (5, "未完"), (6, "第二章 檢查"), (7, "每年一次。")]


@query(values("at int, heading string, text string", [(1, "第一章 總則", "第一章 總則"), (2, "第一章 總則", "本手冊說明防火門。"), (4, "第一章 總則", "第二句未完"), (6, "第二章 檢查", "第二章 檢查"), (7, "第二章 檢查", "每年一次。")]))
def paragraphs_of_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([("d", at, t) for at, t in LINES], "doc string, line int, text string")
    return evidence.joined_paragraphs(rows, "doc", "line", "text", "^第[一二三]章").select("at", "heading", "text")


@query(with_tables("SELECT ruling, law, count(*) AS n FROM (SELECT DISTINCT ruling, law FROM referred) GROUP BY ruling, law", "referred"))
def referred_laws(spark: SparkSession, sf: str) -> DataFrame:
    refs = fixture(spark, "referred")
    return evidence.related_rulings(refs.withColumn("article", F.lit("")), "law", "article", "ruling").groupBy("ruling", "law").agg(F.count("*").alias("n"))
