"""Evidence, source and section queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import aggregates, changes, evidence, graph, joins, windows
from quern.plans.registry import query, table
from quern.sinks import tables
from quern.sources import records


@query("SELECT doc_id, substr(text, 1, 24000) AS quote, length(text) > 24000 AS cut, sha256(text) AS content_hash FROM documents")
def evidence_quotes(spark: SparkSession, sf: str) -> DataFrame:
    rows = evidence.evidence(table(spark, sf, "documents"), "article", F.col("text"), doc=F.col("doc_id"))
    return rows.select(F.col("locator.doc").cast("long").alias("doc_id"), "quote", "cut", "content_hash")


@query("""SELECT doc_id, list_sort(list_distinct(list_concat([source], CASE WHEN quality = 1 THEN ['good', source] ELSE [] END))) AS words FROM documents LEFT JOIN labels USING (doc_id)""")
def keyword_union(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.array("source").alias("words"))
    more = table(spark, sf, "labels").where("quality = 1").join(table(spark, sf, "documents"), "doc_id").select("doc_id", F.array(F.lit("good"), "source").alias("words"))
    return evidence.keyword_union(docs, more, "doc_id", "words").withColumn("words", F.sort_array("words"))


@query("SELECT DISTINCT l_partkey, l_suppkey, l_orderkey FROM lineitem")
def related_orders(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.related_rulings(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey", "l_orderkey")


@query("""WITH c AS (SELECT conv_id, turn, text, max(CASE WHEN role = 'user' THEN turn END) OVER w AS h, count(CASE WHEN role = 'user' THEN 1 END) OVER w AS section FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT c.conv_id, c.turn, c.section, 'user ' || h AS heading FROM c""")
def sectioned_turns(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws(" ", "role", "turn").alias("line"))
    return evidence.sectioned_lines(rows, "conv_id", ["turn"], "line", "^user ").select("conv_id", "turn", "section", "heading")


@query("""WITH s AS (SELECT n_regionkey, n_nationkey + 1 AS a, n_nationkey + 3 AS b FROM nation), p AS (SELECT s_suppkey, s_nationkey AS page, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
f AS (SELECT n_regionkey, min(a) AS first FROM s GROUP BY 1), m AS (SELECT p.s_suppkey, p.n_regionkey, s.a FROM p LEFT JOIN s ON s.n_regionkey = p.n_regionkey AND p.page BETWEEN s.a AND s.b)
SELECT s_suppkey, coalesce(m.a, f.first) AS section_id FROM m LEFT JOIN f USING (n_regionkey)""")
def page_sections(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    start = F.col("n_nationkey") + 1
    sections = nation.select("n_regionkey", start.alias("section_id"), start.alias("start_page"), (start + 2).alias("end_page"))
    pages = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("page")).join(nation.select(F.col("n_nationkey").alias("page"), "n_regionkey"), "page")
    return evidence.section_of(pages, sections, "n_regionkey").select("s_suppkey", "section_id")


@query("""WITH n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 1 THEN text || '.' ELSE text END) AS h, CASE WHEN doc_id % 5 = 2 THEN 'x' ELSE source END AS s FROM documents WHERE doc_id % 5 <> 3)
SELECT d.doc_id, CASE WHEN n.doc_id IS NULL THEN 'gone' WHEN n.h <> sha256(d.text) THEN 'text-changed' WHEN n.s IS DISTINCT FROM d.source THEN 'source-changed' ELSE 'same' END AS state FROM documents d LEFT JOIN n USING (doc_id)""")
def evidence_states(spark: SparkSession, sf: str) -> DataFrame:
    docs, i = table(spark, sf, "documents"), F.col("doc_id") % 5
    saved = docs.select("doc_id", F.sha2("text", 256).alias("content_hash"), F.col("source").alias("source_hash"))
    now = docs.where(i != 3).select("doc_id", F.sha2(F.when(i == 1, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("content_hash"), F.when(i == 2, "x").otherwise(F.col("source")).alias("source_hash"))
    return evidence.compared(saved, now, "doc_id").select("doc_id", "state")


@query("""SELECT o_orderkey, list_concat(CASE WHEN o_orderkey % 6 = 0 THEN ['o_orderstatus'] ELSE [] END, CASE WHEN o_orderkey % 10 = 0 THEN ['o_custkey'] ELSE [] END) AS differ FROM orders WHERE o_orderkey % 6 = 0 OR o_orderkey % 10 = 0""")
def extraction_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    k = F.col("o_orderkey")
    b = a.select(k, F.when(k % 6 == 0, "?").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(k % 10 == 0, -1).otherwise(F.col("o_custkey")).alias("o_custkey"))
    return evidence.mismatches(a, b, ["o_orderkey"], ["o_orderstatus", "o_custkey"])


@query("""WITH n AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
g AS (SELECT doc_id, text, 0 AS f, n // 8 AS t FROM n UNION ALL SELECT doc_id, text, n // 4, n // 2 FROM n UNION ALL SELECT doc_id, text, n - n // 8, n FROM n)
SELECT doc_id, CAST(f AS INT) AS gap_start, CAST(t AS INT) AS gap_end, substr(text, f + 1, t - f) AS gap FROM g WHERE f < t""")
def uncovered_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with three spans each, two of which overlap; an empty text has no spans."""
    part = lambda a, b: F.struct(F.expr(a).cast("int").alias("a"), F.expr(b).cast("int").alias("b"))
    spans = F.explode(F.array(part("n div 8", "n div 4"), part("n div 2", "n - n div 4"), part("n - n div 3", "n - n div 8")))
    rows = table(spark, sf, "documents").select("doc_id", "text", F.length("text").alias("n")).where("n > 0").select("doc_id", "text", spans.alias("s")).select("doc_id", "text", "s.*")
    return evidence.gaps(rows, "doc_id", "text", "a", "b")


@query("SELECT page_id, upper(regexp_extract(html, '<html lang=\"([a-z]+)\"', 1)) AS lang FROM pages")
def page_languages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.upper(records.html_attribute("html", "html", "lang")).alias("lang"))


@query()
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    """Visible text of every page; SQL has no HTML parser, so tests hold it against one page at a time."""
    return table(spark, sf, "pages").select("page_id", records.html_text("html").alias("text"))


@query("SELECT l_returnflag AS region, count(DISTINCT l_suppkey) AS files, sum(DISTINCT l_suppkey * 10) AS bytes FROM lineitem GROUP BY 1")
def pack_sizes(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("region"), F.col("l_suppkey").alias("url"), (F.col("l_suppkey") * 10).alias("bytes"))
    return tables.packs(files, "region")


@query("SELECT DISTINCT l_suppkey AS url FROM lineitem WHERE l_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_partkey < 100)")
def unused_files(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("url"), "l_partkey")
    return tables.unused_files(files, files.where("l_partkey < 100"))


@query("SELECT doc_id, doc_id // 256 AS bucket FROM documents WHERE doc_id // 256 = 0 AND doc_id = 77")
def bucket_lookup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", tables.range_bucket(F.col("doc_id")).alias("bucket"))
    return docs.where("bucket = 0 and doc_id = 77")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, list(l_partkey) AS refs FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT count(*) AS n, count(*) FILTER (len(list_filter(refs, lambda x: x IS NOT NULL)) > 0) AS with_refs, CAST(sum(len(list_filter(refs, lambda x: x IS NOT NULL))) AS BIGINT) AS n_refs, CAST(0 AS BIGINT) AS n_citations, count(DISTINCT o_custkey) AS n_numbers FROM o""")
def archive_stats(spark: SparkSession, sf: str) -> DataFrame:
    refs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_partkey").alias("refs"))
    orders = table(spark, sf, "orders").join(refs, "o_orderkey", "left").select(F.coalesce("refs", F.array().cast("array<long>")).alias("refs"), F.array().cast("array<long>").alias("citations"), F.col("o_custkey").alias("number_key"))
    return evidence.archive_stats(orders)


@query("SELECT min(o_totalprice) AS x0, max(o_totalprice) AS x1, min(o_custkey) AS y0, max(o_custkey) AS y1 FROM orders")
def bounding_box(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bounds(table(spark, sf, "orders").select(F.col("o_totalprice").alias("x"), F.col("o_custkey").alias("y")))


_Z1 = "(z * cos(0.3) - x * sin(0.3))"


@query(f"""WITH p AS (SELECT s_suppkey, CAST(s_suppkey AS DOUBLE) AS x, CAST(s_nationkey AS DOUBLE) AS y, s_acctbal / 1000 AS z FROM supplier)
SELECT s_suppkey, round((x * cos(0.3) + z * sin(0.3)) * 500 / (500 + {_Z1} * cos(0.2) + y * sin(0.2)), 4) AS sx, round((y * cos(0.2) - {_Z1} * sin(0.2)) * 500 / (500 + {_Z1} * cos(0.2) + y * sin(0.2)), 4) AS sy FROM p""")
def rotated_points(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "supplier").select("s_suppkey", F.col("s_suppkey").cast("double").alias("x"), F.col("s_nationkey").cast("double").alias("y"), (F.col("s_acctbal") / 1000).alias("z"))
    return graph.rotated(points, 0.3, 0.2, 500.0).select("s_suppkey", F.round("sx", 4).alias("sx"), F.round("sy", 4).alias("sy"))


@query("""SELECT c_custkey, c_nationkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c.c_nationkey AND s_acctbal < 0)""")
def not_referenced(spark: SparkSession, sf: str) -> DataFrame:
    bad = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey"))
    return changes.violations(bad.withColumnRenamed("c_nationkey", "k"), table(spark, sf, "customer"), "k", "c_nationkey").select("c_custkey", "c_nationkey", "c_mktsegment")


@query("""SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id""")
def capture_dates(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.observed(table(spark, sf, "events"), ["user_id"], "ts").select("user_id", "n", F.col("first").alias("first_ts"), F.col("last").alias("last_ts"))


@query("""WITH d AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS before, source FROM documents) SELECT doc_id, before, source FROM d WHERE before IS NOT NULL AND doc_id - before > 20""")
def ordinal_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return windows.gaps_between(table(spark, sf, "documents"), ["source"], "doc_id", 20).select("doc_id", F.col("previous").alias("before"), "source")


@query("""WITH c AS (SELECT text, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1) SELECT doc_id, first, n FROM documents JOIN c USING (text)""")
def equal_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Each copy with the first of its class and the size of that; copies are never paired."""
    return joins.equal_classes(table(spark, sf, "documents"), "doc_id", "text")


@query("SELECT event_type, count(*) AS candidates, count(*) FILTER (value > 40) AS missing FROM events GROUP BY event_type")
def incomplete_results(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.coverage_share(table(spark, sf, "events"), F.col("value") > 40, "event_type")


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents), n AS (SELECT DISTINCT lower(p_type) AS word FROM part UNION SELECT 'the') SELECT doc_id, word FROM w JOIN n USING (word)""")
def vocabulary_hits(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select(F.lower("p_type").alias("word")).union(spark.createDataFrame([("the",)], "word string")).distinct()
    return joins.vocabulary_hits(table(spark, sf, "documents"), "doc_id", "text", names, "word")


