"""Window, ordering and text queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import chains, dates, text
from quern.operators import windows
from quern.plans.registry import query, table
from quern.sources import records


@query("""WITH m AS (SELECT conv_id, turn, role, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS fresh FROM conversations)
SELECT conv_id, turn, role, CAST(sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM m""")
def chapter_runs(spark: SparkSession, sf: str) -> DataFrame:
    return windows.runs(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], F.col("role"))


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 9 END AS level, event_type || event_id AS label FROM events),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM e),
b AS (SELECT *, max(CASE WHEN level = 1 THEN pos END) OVER w AS a1, max(CASE WHEN level = 2 THEN pos END) OVER w AS a2, max(CASE WHEN level = 3 THEN pos END) OVER w AS a3,
  last_value(CASE WHEN level = 1 THEN label END IGNORE NULLS) OVER w AS l1, last_value(CASE WHEN level = 2 THEN label END IGNORE NULLS) OVER w AS l2, last_value(CASE WHEN level = 3 THEN label END IGNORE NULLS) OVER w AS l3
  FROM a WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT event_id, l1 AS h1, CASE WHEN a1 IS NULL OR a2 > a1 THEN l2 END AS h2, CASE WHEN greatest(a1, a2) IS NULL OR a3 > greatest(a1, a2) THEN l3 END AS h3 FROM b""")
def heading_stack(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    level = F.when(kind == "signup", 1).when(kind == "view", 2).when(kind == "click", 3).otherwise(9)
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts", level.alias("level"), F.concat("event_type", "event_id").alias("label"))
    return windows.heading_stack(rows, ["user_id"], ["ts", "event_id"], "level", "label", 3).select("event_id", "h1", "h2", "h3")


@query("""WITH s AS (SELECT conv_id, turn, length(text) AS len, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS start, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations)
SELECT conv_id, turn, CAST(start AS BIGINT) AS start, CAST(coalesce(lead(start) OVER (PARTITION BY conv_id ORDER BY start, turn), total) AS BIGINT) AS "end" FROM s WHERE len > 0""")
def segment_lead(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id")
    n = F.length("text")
    rows = table(spark, sf, "conversations").where(n > 0).select("conv_id", "turn", (F.sum(n).over(w.orderBy("turn")) - n).alias("start"), F.sum(n).over(w).alias("total"))
    return windows.segments(rows, ["conv_id"], "start", F.col("total")).select("conv_id", "turn", "start", "end")


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM f) SELECT user_id, event_type, event_id FROM r WHERE rn <= 3""")
def first_n_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return windows.first_occurrences(table(spark, sf, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id", 3)


@query("""SELECT lang, source, max(doc_id) AS value, min(doc_id) AS doc_id FROM documents GROUP BY lang, source""")
def last_wins_first_place(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("lang", "source", F.col("doc_id").alias("value"), "doc_id")
    return windows.keyed_dedup(rows, ["lang", "source"], "doc_id", keep="last")


@query("""SELECT event_id, lag(event_type) OVER w AS previous, lag(event_type) OVER w IS DISTINCT FROM event_type AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def version_chain(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return windows.version_chain(rows, "user_id", ["ts", "event_id"], "event_type").select("event_id", "previous", "changed")


@query("""WITH s AS (SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS used FROM conversations),
n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) - count(*) FILTER (used <= 500) OVER (PARTITION BY conv_id) AS left_out FROM s) SELECT conv_id, turn, used, left_out FROM n WHERE used <= 500""")
def running_budget(spark: SparkSession, sf: str) -> DataFrame:
    return windows.within_budget(table(spark, sf, "conversations"), ["conv_id"], ["turn"], F.length("text"), 500).select("conv_id", "turn", "used", "left_out")


@query("""SELECT conv_id, bool_and(turn = rn - 1) AS ok, count(*) AS n FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id""")
def numbering_continuity(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("turn") + 1).alias("number"))
    return windows.consecutive(rows, ["conv_id"], "turn", "number")


@query("""WITH s AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS a, CAST(floor(value) AS BIGINT) + 20 AS b FROM events WHERE value IS NOT NULL),
m AS (SELECT *, greatest(a, coalesce(max(b) OVER (PARTITION BY user_id ORDER BY a, b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a)) AS c FROM s) SELECT user_id, sum(b - c) AS covered, count(*) AS n FROM m WHERE c < b GROUP BY user_id""")
def clamped_spans(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").where("value is not null").select("user_id", "event_id", F.floor("value").cast("long").alias("a"))
    rows = rows.select("user_id", "event_id", "a", (F.col("a") + 20).alias("b"))
    return windows.clamped(rows, ["user_id"], "a", "b").groupBy("user_id").agg(F.sum(F.col("b") - F.col("a")).alias("covered"), F.count("*").alias("n"))


@query("""WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '民國 ' || (year(o_orderdate) - 1911) || ' 年 ' || month(o_orderdate) || ' 月 ' || day(o_orderdate) || ' 日' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y%m%d') ELSE '99991231' END AS modified, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o_orderkey, modified, CASE WHEN o_orderkey % 4 < 3 THEN day END AS modified_date FROM d""")
def mixed_dates(spark: SparkSession, sf: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    roc = F.concat(F.lit("民國 "), F.year(d) - 1911, F.lit(" 年 "), F.month(d), F.lit(" 月 "), F.day(d), F.lit(" 日"))
    modified = F.when(k == 0, roc).when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, F.date_format(d, "yyyyMMdd")).otherwise("99991231")
    return table(spark, sf, "orders").select("o_orderkey", modified.alias("modified")).withColumn("modified_date", dates.any_date(F.col("modified")))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 40")
def recent_first(spark: SparkSession, sf: str) -> DataFrame:
    return windows.page_of(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), 1, 40, F.desc("o_orderdate"), F.col("o_orderkey"))


@query("""SELECT n_name, c_custkey, c_acctbal, rn FROM (SELECT n_name, c_custkey, c_acctbal, row_number() OVER (PARTITION BY n_name ORDER BY (c_mktsegment <> 'BUILDING'), c_acctbal DESC, c_custkey) AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE rn <= 5""")
def top_per_region(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    top = windows.top_per_group(rows, ["n_name"], 5, F.col("c_mktsegment") != "BUILDING", F.desc("c_acctbal"), F.col("c_custkey"))
    return top.select("n_name", "c_custkey", "c_acctbal", "rn")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10 OFFSET 20")
def second_page(spark: SparkSession, sf: str) -> DataFrame:
    return windows.page_of(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal"), 3, 10, F.desc("s_acctbal"), F.col("s_suppkey"))


@query("""SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || '}') AS content_hash FROM documents""")
def hash_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.fingerprint(F.col("doc_id"), F.col("lang"), F.col("source")).alias("content_hash"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '%%%|\\$\\$\\$') THEN 'signs' WHEN regexp_matches(text, '!! ') THEN 'loud' WHEN regexp_matches(text, ' \\| ') THEN 'table' ELSE 'prose' END AS topic FROM documents""")
def topic_chain(spark: SparkSession, sf: str) -> DataFrame:
    rules = [(r"%%%|\$\$\$", "signs"), ("!! ", "loud"), (r" \| ", "table")]
    return table(spark, sf, "documents").select("doc_id", chains.first_match(F.col("text"), rules, "prose").alias("topic"))


@query("""SELECT doc_id, CASE WHEN s > 0 THEN '…' ELSE '' END || substr(text, CAST(s + 1 AS INT), 150) || CASE WHEN length(text) > s + 150 THEN '…' ELSE '' END AS excerpt
FROM (SELECT doc_id, text, greatest(0, coalesce(least(nullif(strpos(text, 'idiot'), 0), nullif(strpos(text, 'password'), 0)), 1) - 26) AS s FROM documents)""")
def excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.excerpt(F.col("text"), ["idiot", "password"]).alias("excerpt"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS safe FROM documents")
def escaped_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.html_escape(F.col("text")).alias("safe"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", records.json_field("props", "k", "long").alias("k"))


@query("SELECT doc_id, regexp_replace(text, '(idiot|moron|scum)', '<mark>\\1</mark>', 'g') AS marked FROM documents")
def highlighted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.highlighted(F.col("text"), ["idiot", "moron", "scum"]).alias("marked"))


@query("SELECT doc_id, regexp_replace(text, '[\\s\\x0b]+', '', 'g') AS squashed FROM documents")
def squashed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.squash(F.col("text")).alias("squashed"))


@query("SELECT event_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day FROM events")
def taipei_days(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", dates.taipei_date(F.col("ts").cast("timestamp")).alias("day"))
