"""Queries whose keys have no bound: one long key, joins without a key, chains, scopes and merged streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import canonical, cuts
from quern.functions.numerals import cn_number
from quern.functions.text import fnv1a_hash
from quern.operators import blocks, intervals, nearest, scans, scopes
from quern.plans.registry import query, table
from quern.sources.records import json_field


@query("""WITH m AS (SELECT conv_id, turn, role, CASE WHEN role = lag(role) OVER (ORDER BY conv_id, turn) THEN 0 ELSE 1 END AS fresh FROM conversations)
SELECT conv_id, turn, role, CAST(sum(fresh) OVER (ORDER BY conv_id, turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM m""")
def runs_of_one_key(spark: SparkSession, sf: str) -> DataFrame:
    """All turns of all conversations as one sequence."""
    return scans.runs(table(spark, sf, "conversations").select("conv_id", "turn", "role"), [], ["conv_id", "turn"], F.col("role"))


_LEVEL = "CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 9 END"


def _headings_sql(by: str) -> str:
    return f"""WITH a AS (SELECT event_id, user_id, {_LEVEL} AS level, event_type || event_id AS label, row_number() OVER ({by} ORDER BY ts, event_id) AS pos FROM events),
b AS (SELECT *, max(CASE WHEN level = 1 THEN pos END) OVER w AS a1, max(CASE WHEN level = 2 THEN pos END) OVER w AS a2, max(CASE WHEN level = 3 THEN pos END) OVER w AS a3,
  last_value(CASE WHEN level = 1 THEN label END IGNORE NULLS) OVER w AS l1, last_value(CASE WHEN level = 2 THEN label END IGNORE NULLS) OVER w AS l2, last_value(CASE WHEN level = 3 THEN label END IGNORE NULLS) OVER w AS l3
  FROM a WINDOW w AS ({by} ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT event_id, l1 AS h1, CASE WHEN a1 IS NULL OR a2 > a1 THEN l2 END AS h2, CASE WHEN greatest(a1, a2) IS NULL OR a3 > greatest(a1, a2) THEN l3 END AS h3 FROM b"""


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    level = F.when(kind == "signup", 1).when(kind == "view", 2).when(kind == "click", 3).otherwise(9)
    return table(spark, sf, "events").select("user_id", "event_id", "ts", level.alias("level"), F.concat("event_type", "event_id").alias("label"))


@query(_headings_sql(""))
def headings_of_one_key(spark: SparkSession, sf: str) -> DataFrame:
    """All events as one document with headings of three levels."""
    return scans.heading_stack(_levels(spark, sf), [], ["ts", "event_id"], "level", "label", 3).select("event_id", "h1", "h2", "h3")


@query(_headings_sql("PARTITION BY user_id"))
def headings_across_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The same by user: most users lie in one range, some go on in the next."""
    return scans.heading_stack(_levels(spark, sf), ["user_id"], ["ts", "event_id"], "level", "label", 3).select("event_id", "h1", "h2", "h3")


@query("""WITH s AS (SELECT conv_id, turn, CAST(sum(length(text)) OVER (ORDER BY conv_id, turn) AS BIGINT) AS used FROM conversations)
SELECT conv_id, turn, used, (SELECT count(*) FILTER (used > 50000) FROM s) AS left_out FROM s WHERE used <= 50000""")
def budget_of_one_key(spark: SparkSession, sf: str) -> DataFrame:
    return scans.within_budget(table(spark, sf, "conversations"), [], ["conv_id", "turn"], F.length("text"), 50_000).select("conv_id", "turn", "used", "left_out")


@query("""WITH s AS (SELECT event_id, CAST(floor(value * 1000) AS BIGINT) AS a, CAST(floor(value * 1000) AS BIGINT) + 20 AS b FROM events WHERE value IS NOT NULL),
m AS (SELECT *, greatest(a, coalesce(max(b) OVER (ORDER BY a, b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a)) AS c FROM s) SELECT event_id, c AS a, b FROM m WHERE c < b""")
def clamped_of_one_key(spark: SparkSession, sf: str) -> DataFrame:
    """Spans on one line for all events, cut where those before them end."""
    rows = table(spark, sf, "events").where("value is not null").select("event_id", F.floor(F.col("value") * 1000).cast("long").alias("a"))
    return scans.clamped(rows.withColumn("b", F.col("a") + 20), [], "a", "b", "event_id")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM events")
def latest_of_one_key(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "ts", "event_type")
    return scans.latest_before(events, [], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), "latest").select("event_id", "latest")


_DAYS = "date_diff('day', DATE '1970-01-01', {}::DATE)"
_SPANS = f"SELECT l_orderkey, l_linenumber, l_suppkey, {_DAYS.format('l_shipdate')} AS a, {_DAYS.format('l_shipdate')} + l_quantity::BIGINT AS b FROM lineitem"


def shipping_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Each line as the days from its shipping on, one for each piece."""
    day = F.unix_date(F.to_date("l_shipdate")).cast("long")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", day.alias("a"), (day + F.col("l_quantity").cast("long")).alias("b"))


def order_days(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.unix_date(F.to_date("o_orderdate")).cast("long").alias("day")).distinct()


@query(f"""SELECT d.day, count(*) AS n, sum(s.b - d.day)::BIGINT AS days_left, min(s.l_orderkey) AS first_order FROM (SELECT DISTINCT {_DAYS.format('o_orderdate')} AS day FROM orders) d JOIN ({_SPANS}) s ON d.day >= s.a AND d.day < s.b GROUP BY d.day""")
def spans_over_days(spark: SparkSession, sf: str) -> DataFrame:
    """Order days inside shipping spans: a range join without a key, by bins."""
    met = intervals.binned_join(order_days(spark, sf), shipping_spans(spark, sf), "day", "a", "b", width=4)
    return met.groupBy("day").agg(F.count("*").alias("n"), F.sum(F.col("b") - F.col("day")).alias("days_left"), F.min("l_orderkey").alias("first_order"))


@query(f"""SELECT d.day, count(s.a) AS held FROM (SELECT DISTINCT {_DAYS.format('o_orderdate')} AS day FROM orders) d LEFT JOIN ({_SPANS}) s ON d.day >= s.a AND d.day < s.b GROUP BY d.day""")
def counted_over_days(spark: SparkSession, sf: str) -> DataFrame:
    """The same counts without pairs: one running sum over the line of days."""
    return intervals.counted_inside(order_days(spark, sf), shipping_spans(spark, sf), "day", "a", "b")


def _events_sql(kind: str) -> str:
    return f"SELECT event_id, floor(value * 1000)::BIGINT AS a, floor(value * 1000)::BIGINT + 20 AS b FROM events WHERE event_type = '{kind}' AND value IS NOT NULL"


@query(f"""SELECT x.event_id, y.event_id AS other FROM ({_events_sql('purchase')}) x JOIN ({_events_sql('signup')}) y ON x.a < y.b AND y.a < x.b""")
def overlapping_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of two kinds of events that share a place on one line."""
    a = F.floor(F.col("value") * 1000).cast("long")
    spans = lambda kind: table(spark, sf, "events").where(F.col("event_type") == kind).where("value is not null").select("event_id", a.alias("a"), (a + 20).alias("b"))
    return intervals.overlapping(spans("purchase"), spans("signup"), "a", "b", width=16).select("event_id", F.col("event_id_b").alias("other"))


def _chain_sql(key: str) -> str:
    same = f"t.{key} = s.{key} AND" if key else ""
    by = f"PARTITION BY {key}" if key else ""
    first = f"n IN (SELECT min(n) FROM s GROUP BY {key})" if key else "n = 1"
    return f"""WITH RECURSIVE s AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {key + ',' if key else ''} a, b, l_orderkey, l_linenumber) AS n FROM ({_SPANS})),
k AS MATERIALIZED (SELECT {key + ',' if key else ''} a, min(n) AS n FROM s GROUP BY ALL), j AS MATERIALIZED (SELECT s.n, min(t.n) AS m FROM s JOIN k t ON {same} t.a >= s.b GROUP BY s.n),
c AS (SELECT n FROM s WHERE {first} UNION ALL SELECT j.m FROM c JOIN j USING (n)) SELECT l_orderkey, l_linenumber, l_suppkey, a, b FROM s JOIN c USING (n)"""


@query(_chain_sql("l_suppkey"))
def disjoint_by_supplier(spark: SparkSession, sf: str) -> DataFrame:
    """From the first line of each supplier on, the next that ships when the last one kept is over."""
    return intervals.disjoint_chain(shipping_spans(spark, sf), ["l_suppkey"], "a", "b", "l_orderkey", "l_linenumber")


@query(_chain_sql(""))
def disjoint_of_one_key(spark: SparkSession, sf: str) -> DataFrame:
    """The same over all lines at once."""
    return intervals.disjoint_chain(shipping_spans(spark, sf), [], "a", "b", "l_orderkey", "l_linenumber")


_CUT_SQL = """WITH p AS (SELECT {keys}, generate_subscripts(p, 1) AS i, unnest(p) AS t FROM (SELECT {keys}, {parts} AS p FROM {table} WHERE text <> '')),
e AS (SELECT {keys}, i, t, sum(length(t)) OVER (PARTITION BY {keys} ORDER BY i) AS e FROM p) SELECT {keys}, (e - length(t))::INT AS "start", e::INT AS "end", sha256(t) AS digest FROM e"""


@query(_CUT_SQL.format(keys="doc_id", table="documents", parts="list_filter(list_transform(string_split(text, chr(10)), lambda x, i: x || CASE WHEN i < len(string_split(text, chr(10))) THEN chr(10) ELSE '' END), lambda x: x <> '')"))
def lines_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every text cut where lines begin, with the places of the pieces."""
    rows = table(spark, sf, "documents").select("doc_id", F.explode(cuts.pieces(F.col("text"), r"(?<=\n)")).alias("p"))
    return rows.select("doc_id", "p.start", "p.end", F.sha2("p.text", 256).alias("digest"))


_CAPITAL = "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"


@query(f"""WITH m AS (SELECT conv_id, turn, regexp_split_to_array(text, '{_CAPITAL}') AS gaps, regexp_extract_all(text, '{_CAPITAL}') AS found FROM conversations),
p AS (SELECT conv_id, turn, unnest(range(1, len(found) + 1)) AS i, gaps, found FROM m), e AS (SELECT conv_id, turn, found[i] AS word, sum(length(gaps[i]) + length(found[i])) OVER (PARTITION BY conv_id, turn ORDER BY i) AS e FROM p)
SELECT conv_id, turn, (e - length(word))::INT AS "start", e::INT AS "end", word FROM e""")
def marked_words(spark: SparkSession, sf: str) -> DataFrame:
    """Every word with a capital in the turns, with its place."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(cuts.matches(F.col("text"), _CAPITAL)).alias("m"))
    return rows.select("conv_id", "turn", "m.start", "m.end", F.col("m.text").alias("word"))


_POINTS = "(?<=[.!?]) "


@query("""WITH s AS (SELECT conv_id, turn, regexp_replace(text, '([.!?]) ', '\\1' || chr(1) || ' ', 'g') AS t FROM conversations WHERE text <> ''), p AS (SELECT conv_id, turn, unnest(string_split(t, chr(1))) AS t FROM s)
SELECT conv_id, turn, count(*) AS n, max(length(t)) AS longest FROM p GROUP BY conv_id, turn""")
def points_of_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns cut at the space after a sentence: how many pieces, and the longest."""
    p = cuts.sections(F.col("text"), _POINTS)
    return table(spark, sf, "conversations").where("text <> ''").select("conv_id", "turn", F.size(p).cast("long").alias("n"), F.array_max(F.transform(p, lambda x: F.length(x["text"]))).cast("long").alias("longest"))


_JSON = "CASE WHEN {0} IS NULL THEN 'null' ELSE to_json({0})::VARCHAR END"


@query(f"""SELECT doc_id, sha256('{{"doc_id":' || doc_id || ',"lang":' || {_JSON.format('lang')} || ',"n_chars":' || n_chars || ',"source":' || {_JSON.format('source')} || ',"text":' || {_JSON.format('text')} || '}}') AS digest FROM documents""")
def canonical_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", canonical.digest(docs).alias("digest"))


@query("""SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","props":{"k":' || json_extract(props, '$.k') || '}}') AS digest FROM events""")
def canonical_props(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their JSON text read as a value: spaces and order in it don't count."""
    events = table(spark, sf, "events").withColumn("props", F.parse_json("props"))
    return events.select("event_id", canonical.digest(events, "event_id", "event_type", "props").alias("digest"))


@query(f"""WITH t AS (SELECT conv_id, turn, '{{"role":' || {_JSON.format('role')} || ',"text":' || {_JSON.format('text')} || ',"turn":' || turn || '}}' AS j FROM conversations)
SELECT conv_id, sha256('{{"conv_id":' || conv_id || ',"turns":[' || string_agg(j, ',' ORDER BY turn) || ']}}') AS digest FROM t GROUP BY conv_id""")
def canonical_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation with its turns as one nested record."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))  # of one conversation
    return turns.select("conv_id", canonical.digest(turns).alias("digest"))


@query("""SELECT doc_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(list_filter(string_split(coalesce(text, ''), ''), lambda c: c <> ''), lambda c: unicode(c)::BIGINT)), lambda h, u: (xor(h, u) * 16777619) % 4294967296) AS hash FROM documents""")
def folded_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """The short hash of every text, folded over its characters."""
    return table(spark, sf, "documents").select("doc_id", fnv1a_hash(F.coalesce("text", F.lit(""))).alias("hash"))


@query("""SELECT o_orderkey, o_orderkey::VARCHAR AS by_digits, (o_orderkey % 10000)::VARCHAR AS by_value FROM orders""")
def numerals_of_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Order keys written in Chinese numerals, digit by digit and by value, and read again."""
    key, signs = F.col("o_orderkey"), "零一二三四五六七八九"
    sign = lambda d: F.translate(d.cast("string"), "0123456789", signs)
    small = key % 10000
    part = lambda unit, name: F.when(F.floor(small / unit) % 10 > 0, F.concat(sign(F.floor(small / unit) % 10), F.lit(name))).otherwise("")
    value = F.concat(part(1000, "千"), part(100, "百"), part(10, "十"), part(1, ""))
    return table(spark, sf, "orders").select("o_orderkey", cn_number(sign(key)).alias("by_digits"), cn_number(F.when(value == "", "零").otherwise(value)).alias("by_value"))


@query("""WITH c AS (SELECT c_custkey, floor(c_acctbal)::BIGINT AS x, c_custkey * 7919 % 10000 AS y FROM customer), s AS (SELECT s_suppkey, floor(s_acctbal)::BIGINT AS x, s_suppkey * 104729 % 10000 AS y, s_nationkey AS z FROM supplier),
d AS (SELECT c_custkey, s_suppkey, z, (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) AS distance FROM c, s)
SELECT c_custkey, s_suppkey, distance FROM d QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY distance, z DESC, s_suppkey) = 1""")
def nearest_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's place with the nearest supplier's; of equally near ones the frontmost."""
    customers = table(spark, sf, "customer").select("c_custkey", F.floor("c_acctbal").alias("x"), (F.col("c_custkey") * 7919 % 10000).alias("y"))
    suppliers = table(spark, sf, "supplier").select("s_suppkey", F.floor("s_acctbal").alias("x"), (F.col("s_suppkey") * 104729 % 10000).alias("y"), "s_nationkey")
    return nearest.nearest(customers, suppliers, ["c_custkey"], "s_suppkey", [-F.col("s_nationkey")])


_KIND = "CAST(json_extract(props, '$.k') AS BIGINT) % 5"


@query(f"""WITH e AS (SELECT *, row_number() OVER (ORDER BY user_id, ts, event_id) AS n, {_KIND} AS kind FROM events),
c AS (SELECT *, max(CASE WHEN event_type = 'error' THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cleared, max(CASE WHEN event_type = 'purchase' THEN n END) OVER (PARTITION BY user_id, kind ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS told FROM e)
SELECT c.event_id, p.event_id AS in_force FROM c LEFT JOIN e p ON p.n = c.told AND (c.cleared IS NULL OR c.told > c.cleared) WHERE c.event_type = 'click'""")
def declarations_in_force(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks with the last purchase of their kind by the same user, unless an error came between them."""
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", (json_field("props", "k", "long") % 5).alias("kind"))
    kind = F.col("event_type")
    rows = scopes.in_force(events, ["user_id"], ["ts", "event_id"], F.col("kind"), F.when(kind == "purchase", F.col("event_id")), kind == "error", "in_force")
    return rows.where(kind == "click").select("event_id", "in_force")


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER w AS n, min(CASE WHEN event_type = 'purchase' THEN props END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo, max(CASE WHEN event_type = 'purchase' THEN props END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN lo = hi THEN lo END AS known, CASE WHEN lo IS NULL THEN 0 WHEN lo = hi THEN 1 ELSE 2 END AS known_n FROM e""")
def only_names_so_far(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "props")
    return scopes.only_one_so_far(events, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("props")), "known").select("event_id", "known", "known_n")


@query("""WITH l AS (SELECT conv_id AS doc, turn // 4 AS page, turn % 4 * 10 AS top, text, turn % 8 = 0 AS is_chapter, role = 'system' OR turn % 8 = 5 AS is_section, turn % 3 = 1 AS ends FROM conversations),
i AS (SELECT user_id AS doc, event_id % 2 AS page, event_id % 37 AS top, event_id % 37 + 3 AS bottom, event_id FROM events WHERE event_type = 'signup'),
g0 AS (SELECT *, max(bottom) OVER (PARTITION BY doc, page ORDER BY top, bottom, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM i),
g1 AS (SELECT *, sum(CASE WHEN low IS NULL OR top > low - 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY top, bottom, event_id ROWS UNBOUNDED PRECEDING) AS nr FROM g0),
g AS (SELECT doc, page, min(top) AS top, nr, list(event_id ORDER BY top, event_id) AS pictures FROM g1 GROUP BY doc, page, nr),
b AS (SELECT doc, page, top, 0 AS side, 0 AS nr, text, is_chapter, is_section, is_chapter OR is_section AS is_head, ends, NULL::BIGINT[] AS pictures FROM l UNION ALL SELECT doc, page, top, 1, nr, NULL, false, false, false, false, pictures FROM g),
n AS (SELECT *, row_number() OVER (ORDER BY doc, page, top, side, nr) AS n, sum(is_chapter::INT) OVER w AS chapter, lag(side = 1 OR is_head OR ends) OVER (PARTITION BY doc ORDER BY page, top, side, nr) AS stop FROM b WINDOW w AS (PARTITION BY doc ORDER BY page, top, side, nr ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, sum((is_section AND NOT is_chapter)::INT) OVER (PARTITION BY doc, chapter ORDER BY n ROWS UNBOUNDED PRECEDING) AS section, sum((NOT is_head AND (stop IS NULL OR stop OR side = 1))::INT) OVER (PARTITION BY doc ORDER BY n ROWS UNBOUNDED PRECEDING) AS block FROM n)
SELECT doc, chapter::BIGINT AS chapter, section::BIGINT AS section, block::BIGINT AS block, CASE WHEN min(side) = 1 THEN 'picture' ELSE 'paragraph' END AS type, min(page) AS page, max(page) AS last_page, sha256(coalesce(string_agg(text, '' ORDER BY n), '')) AS digest, coalesce(len(any_value(pictures)), 0) AS n_pictures FROM s WHERE NOT is_head GROUP BY doc, chapter, section, block""")
def merged_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as lines and sign-ups as pictures of the same documents, in sections of blocks."""
    turn = F.col("turn")
    lines = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.floor(turn / 4).alias("page"), (turn % 4 * 10).cast("long").alias("top"), "text", "turn", "role")
    lines = lines.withColumns({"c": turn % 8 == 0, "s": ((F.col("role") == "system") | (turn % 8 == 5)) & (turn % 8 != 0), "e": turn % 3 == 1})
    at = F.col("event_id") % 37
    pictures = table(spark, sf, "events").where("event_type = 'signup'").select(F.col("user_id").alias("doc"), (F.col("event_id") % 2).alias("page"), at.alias("top"), (at + 3).alias("bottom"), "event_id")
    made = blocks.merged(lines, pictures, "doc", F.col("c"), F.col("s"), F.col("e"), "event_id")
    return made.select("doc", "chapter", "section", "block", "type", "page", "last_page", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.coalesce(F.size("pictures"), F.lit(0)).cast("long").alias("n_pictures"))
