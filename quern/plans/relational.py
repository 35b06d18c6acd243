"""Filters, joins, aggregations, set operations and change tracking over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import occurrences
from quern.operators import aggregates, changes, filters, joins
from quern.plans.registry import query, table

STATUSES = ["view", "click", "purchase", "refund", "none"]


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('en', 'de') AND source IN ('src1', 'src2', 'src3')")
def scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return filters.in_scope(docs, lang=["en", "de"], source=["src1", "src2", "src3"], n_chars=None)


@query("SELECT doc_id, (contains(text, 'the') OR contains(text, 'der')) AND (contains(text, 'that') OR contains(text, 'and')) AS hit FROM documents")
def guide_match(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", filters.conjunction_of_any(F.col("text"), [["the", "der"], ["that", "and"]]).alias("hit"))


@query("""SELECT coalesce(CASE WHEN count(*) FILTER (r_name = 'ASIA') = 1 THEN max(CASE WHEN r_name = 'ASIA' THEN r_name END) END,
  CASE WHEN count(*) FILTER (r_name LIKE '%A%') = 1 THEN max(CASE WHEN r_name LIKE '%A%' THEN r_name END) END) AS r_name FROM region""")
def unique_region(spark: SparkSession, sf: str) -> DataFrame:
    return filters.only_one(table(spark, sf, "region"), F.col("r_name") == "ASIA", F.col("r_name").contains("A"), "r_name")


TOPICS = [("early", "[135]$"), ("late", "[789]$"), ("tens", "1[0-9]$")]


@query("""WITH m AS (SELECT doc_id, source, unnest(['early', 'late', 'tens']) AS topic, unnest([regexp_matches(source, '[135]$'), regexp_matches(source, '[789]$'), regexp_matches(source, '1[0-9]$')]) AS hit FROM documents)
SELECT doc_id, source, topic FROM m WHERE hit""")
def topic_membership(spark: SparkSession, sf: str) -> DataFrame:
    return filters.topic_memberships(table(spark, sf, "documents"), F.col("source"), TOPICS, "doc_id", "source")


@query("""WITH m AS (SELECT source, unnest(['early', 'late', 'tens']) AS topic, unnest([regexp_matches(source, '[135]$'), regexp_matches(source, '[789]$'), regexp_matches(source, '1[0-9]$')]) AS hit FROM (SELECT DISTINCT source FROM documents))
SELECT s.source, t.topic FROM (SELECT DISTINCT source FROM m WHERE hit) s, (VALUES ('early'), ('late'), ('tens')) t(topic) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.source = s.source AND m.topic = t.topic AND m.hit)""")
def topic_gaps(spark: SparkSession, sf: str) -> DataFrame:
    members = filters.topic_memberships(table(spark, sf, "documents"), F.col("source"), TOPICS, "source").distinct()
    return filters.missing_topics(members, "source", [t for t, _ in TOPICS])


@query("""SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'price' WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' WHEN year(o_orderdate) < 1994 THEN 'date' END AS reason,
  CAST(CAST(o_totalprice < 1000 AS INT) + CAST(o_orderstatus NOT IN ('F', 'O') AS INT) + CAST(year(o_orderdate) < 1994 AS INT) AS BIGINT) AS n_broken FROM orders""")
def candidate_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("price", F.col("o_totalprice") >= 1000), ("status", F.col("o_orderstatus").isin("F", "O")), ("date", F.year("o_orderdate") >= 1994)]
    return filters.broken_rules(table(spark, sf, "orders"), rules).select("o_orderkey", "reason", F.size("reasons").cast("long").alias("n_broken"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_matches(url, '^https?://[^/@]+(/|$)') AS safe FROM pages""")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    part = lambda p: F.coalesce(F.try_parse_url("url", F.lit(p)), F.lit(""))
    return pages.select("page_id", part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), filters.safe_url(F.col("url")).alias("safe"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(a.s_name, b.s_name) AS s_name FROM lineitem
LEFT JOIN (SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0) a ON a.s_suppkey = l_suppkey LEFT JOIN (SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0) b ON b.s_suppkey = l_linenumber""")
def provenance_fallback(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    source = table(spark, sf, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_name")
    return joins.with_fallback(items, source, "l_suppkey", "l_linenumber", "s_suppkey", "s_name").select("l_orderkey", "l_linenumber", "s_name")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def dictionary_in_texts(spark: SparkSession, sf: str) -> DataFrame:
    docs, names = table(spark, sf, "documents"), table(spark, sf, "benchmark").withColumnRenamed("text", "name")
    return joins.token_matches(docs.select("doc_id", "text"), "text", names, "name", words=3).select("doc_id", "item_id")


@query("""WITH r AS (SELECT l_orderkey, l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE '' END AS detail FROM lineitem),
m AS (SELECT *, max(CAST(detail <> '' AS INT)) OVER (PARTITION BY l_orderkey) AS has FROM r) SELECT l_orderkey, l_suppkey, detail FROM m WHERE detail <> '' OR has = 0""")
def prefer_specific_refs(spark: SparkSession, sf: str) -> DataFrame:
    detail = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise("")
    return joins.specific_first(table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", detail.alias("detail")), ["l_orderkey"], "detail")


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text HAVING count(DISTINCT lang || '/' || source) = 1")
def unique_key_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return joins.unique_keys(table(spark, sf, "documents"), "text", ["lang", "source"], "doc_id")


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def backlinks_semi(spark: SparkSession, sf: str) -> DataFrame:
    return joins.referred_to(table(spark, sf, "part").select("p_partkey", "p_name"), table(spark, sf, "lineitem").where("l_quantity > 45"), "p_partkey", "l_partkey")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM events""")
def latest_previous(spark: SparkSession, sf: str) -> DataFrame:
    latest = joins.latest_before(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return table(spark, sf, "events").select("event_id", latest.alias("latest"))


@query("""SELECT e.event_id, p.event_id AS purchase_id, p.value AS purchase_value FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(struct_pack(event_id, value)).event_id AS event_id, max(struct_pack(event_id, value)).value AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p
ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'click'""")
def as_of_purchase(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"), F.col("value").alias("purchase_value"))
    clicks = events.where("event_type = 'click'").select("user_id", "ts", "event_id")
    return joins.as_of(clicks, bought, ["user_id"], "ts", "ts", ["purchase_id", "purchase_value"]).select("event_id", "purchase_id", "purchase_value")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS e, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
SELECT s.l_orderkey, p.at, s.l_linenumber FROM s JOIN (SELECT o_orderkey, unnest([0, 10, 25, 60]) AS at FROM orders) p ON p.o_orderkey = s.l_orderkey AND p.at >= s.e - s.q AND p.at < s.e""")
def range_containment(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    end = F.sum("l_quantity").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")).cast("long")
    spans = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", end.alias("end"), F.col("l_quantity").cast("long").alias("q")).withColumn("start", F.col("end") - F.col("q")).drop("q")
    points = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array(*[F.lit(x) for x in (0, 10, 25, 60)])).alias("at"))
    return joins.contained_in(points, spans, ["l_orderkey"], "at", "start", "end").select("l_orderkey", "at", "l_linenumber")


@query("""WITH m AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS ord FROM nation), r AS (SELECT r_regionkey AS k, 2 AS a, 4 AS b FROM region)
SELECT r.k AS n_regionkey, m.n_nationkey, m.ord AS ordinal FROM r JOIN m ON m.n_regionkey = r.k AND m.ord BETWEEN r.a AND r.b WHERE r.b - r.a <= 20""")
def ordinal_range_expand(spark: SparkSession, sf: str) -> DataFrame:
    from quern.operators.windows import ordinals

    members = ordinals(table(spark, sf, "nation").select("n_regionkey", "n_nationkey"), ["n_regionkey"], F.col("n_nationkey"))
    ranges = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.lit(2).alias("a"), F.lit(4).alias("b"))
    return joins.expanded_ranges(ranges, members, "n_regionkey", "a", "b", "ordinal").select("n_regionkey", "n_nationkey", F.col("ordinal").cast("long").alias("ordinal"))


def _shipping() -> list[Column]:
    """Days between which an item is under way."""
    day = F.datediff(F.col("l_shipdate"), F.lit("1970-01-01")).cast("long")
    return [day.alias("a"), (day + F.col("l_quantity").cast("long")).alias("b")]


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS a, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber FROM s WHERE l_linenumber % 2 = 0 AND NOT EXISTS (SELECT 1 FROM s t WHERE t.l_linenumber % 2 = 1 AND t.l_orderkey = s.l_orderkey AND s.a < t.b AND s.b > t.a)""")
def overlap_anti(spark: SparkSession, sf: str) -> DataFrame:
    spans = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_shipping())
    return joins.without_overlap(spans.where("l_linenumber % 2 = 0"), spans.where("l_linenumber % 2 = 1"), ["l_orderkey"], "a", "b").select("l_orderkey", "l_linenumber")


@query("""SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 2""")
def relational_division(spark: SparkSession, sf: str) -> DataFrame:
    need = spark.createDataFrame([("F",), ("O",)], "o_orderstatus string")
    return joins.divided_by(table(spark, sf, "orders"), need, "o_custkey", "o_orderstatus")


@query("""SELECT c.event_id, min(p.ts) AS next_purchase FROM events c LEFT JOIN events p ON p.user_id = c.user_id AND p.event_type = 'purchase' AND p.ts >= c.ts WHERE c.event_type = 'view' GROUP BY c.event_id""")
def next_anchor(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    views = events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    anchors = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("next_purchase"))
    return joins.next_at_or_after(views, anchors, ["user_id"], "ts", "next_purchase").select("event_id", "next_purchase")


@query("""SELECT l_partkey, l_suppkey, CAST(2 - grouping(l_suppkey) AS INT) AS level, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY GROUPING SETS ((l_partkey), (l_partkey, l_suppkey))""")
def ref_counts_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.counts_at_levels(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey", "l_orderkey")


@query("""WITH c AS (SELECT r_name, n_name, CAST(2 - grouping(r_name) - grouping(n_name) AS INT) AS level, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name))
SELECT * FROM c UNION ALL SELECT t, NULL, 1, 0 FROM (SELECT r_name AS t FROM region UNION SELECT 'nowhere') WHERE t NOT IN (SELECT r_name FROM c WHERE level = 1)""")
def tree_rollup(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = aggregates.tree_counts(table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "r_name", "n_name")
    tops = table(spark, sf, "region").select("r_name").union(spark.createDataFrame([("nowhere",)], "r_name string"))
    return aggregates.tree_with_empty(counts, tops, "r_name").select("r_name", "n_name", "level", "n")


@query("""SELECT v.event_type, v.ord, count(e.event_id) AS n FROM (VALUES ('view', 0), ('click', 1), ('purchase', 2), ('refund', 3), ('none', 4)) v(event_type, ord) LEFT JOIN events e ON e.event_type = v.event_type GROUP BY v.event_type, v.ord""")
def status_counts_with_zero(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.counts_with_zeros(table(spark, sf, "events"), "event_type", STATUSES)


@query("""SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (quality IS NULL) AS unknown FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def coverage_pivot(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    q = F.col("quality")
    return aggregates.pivot_counts(rows, "lang", [("good", q == 1), ("bad", q == 0), ("unknown", q.isNull())])


@query("SELECT count(*) AS n_all, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'click') AS n_click FROM events")
def facet_counts(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.facet_counts(table(spark, sf, "events"), "event_type", ["view", "click"])


@query("SELECT s_name, s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY s_nationkey HAVING count(DISTINCT s_suppkey) = 1)")
def unique_name_only(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.unambiguous(table(spark, sf, "supplier").select("s_name", "s_suppkey", "s_nationkey"), ["s_nationkey"], "s_suppkey")


@query("""SELECT node, count(*) AS degree FROM (SELECT 'c' || o_custkey AS node FROM orders UNION ALL SELECT 'o' || o_orderkey FROM orders) GROUP BY node""")
def degree(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("o"), "o_orderkey").alias("b"))
    return aggregates.degrees(edges, "a", "b")


@query("""WITH p AS (SELECT p_partkey, string_split(p_type, ' ') AS path, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS ord, p_brand FROM part),
x AS (SELECT p_brand, ord, path, unnest(range(1, len(path) + 1)) AS depth FROM p)
SELECT p_brand, depth, array_to_string(path[1:depth], '/') AS prefix, min(ord) AS first, max(ord) AS last, count(*) AS n FROM x GROUP BY ALL""")
def path_prefix_ranges(spark: SparkSession, sf: str) -> DataFrame:
    from quern.operators.windows import ordinals

    rows = ordinals(table(spark, sf, "part").select("p_partkey", "p_brand", F.split("p_type", " ").alias("path")), ["p_brand"], F.col("p_partkey"))
    out = aggregates.prefix_ranges(rows, "p_brand", "path", "ordinal")
    return out.select("p_brand", F.col("depth").cast("long").alias("depth"), "prefix", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "n")


@query("""WITH n AS (SELECT lang, source, count(*) FILTER (doc_id % 2 = 0) - count(*) FILTER (doc_id % 2 = 1) AS d FROM documents GROUP BY lang, source)
SELECT lang, source, greatest(d, 0) AS only_a, greatest(-d, 0) AS only_b FROM n WHERE d <> 0""")
def multiset_equal(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    side = lambda k: docs.where(F.col("doc_id") % 2 == k).select("lang", "source")
    return aggregates.multiset_difference(side(0), side(1))


@query("SELECT source, min(doc_id) AS first_seen FROM documents GROUP BY source")
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.first_seen_order(table(spark, sf, "documents"), "source", "doc_id")


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'the ', ''))) / 4 AS BIGINT) AS n FROM documents")
def phrase_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", occurrences(F.col("text"), "the ").alias("n"))


@query("""WITH s AS (SELECT l_orderkey, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS a, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS b FROM lineitem),
m AS (SELECT *, CASE WHEN max(b) OVER w IS NULL OR a > max(b) OVER w THEN 1 ELSE 0 END AS fresh FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT l_orderkey, CAST(island AS BIGINT) AS island, min(a) AS a, max(b) AS b, count(*) AS n FROM g GROUP BY l_orderkey, island""")
def merged_intervals(spark: SparkSession, sf: str) -> DataFrame:
    spans = table(spark, sf, "lineitem").select("l_orderkey", *_shipping())
    out = aggregates.merged_intervals(spans, ["l_orderkey"], "a", "b")
    return out.select("l_orderkey", F.col("island").cast("long").alias("island"), "a", "b", "n")


_OLD = "(SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 7 <> 0)"
_NEW = "(SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 11 <> 0)"


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select(k.alias("k"), F.col("o_orderstatus").alias("v"))
    new = orders.where("k % 11 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("v")))
    return orders.where("k % 7 <> 0"), new


@query(f"""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change, a.v AS old, b.v AS new FROM {_OLD} a FULL JOIN {_NEW} b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v""")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return changes.difference(*_snapshots(spark, sf), ["k"], "v")


@query(f"""WITH j AS (SELECT coalesce(p.k, c.k, f.k) AS k, p.v AS b, c.v AS c, f.k IS NOT NULL AS failed FROM {_OLD} p FULL JOIN {_NEW} c ON p.k = c.k FULL JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 0) f ON f.k = coalesce(p.k, c.k)),
s AS (SELECT *, CASE WHEN c IS NOT NULL AND NOT failed THEN CASE WHEN c = b THEN 'unchanged' ELSE 'updated' END WHEN b IS NULL THEN 'unavailable' WHEN failed THEN 'retained' ELSE 'not-attempted' END AS status FROM j)
SELECT k, status, CASE WHEN status = 'updated' THEN c ELSE b END AS kept FROM s""")
def reconcile_status(spark: SparkSession, sf: str) -> DataFrame:
    failed = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"))
    return changes.reconciled(*_snapshots(spark, sf), failed, "k", "v")


@query("""WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag NOT IN ('A') GROUP BY 1)
SELECT a.k, a.n AS before, b.n AS after, CASE WHEN b.n IS NULL THEN 'missing' ELSE 'shrunk' END AS reason FROM a LEFT JOIN b USING (k) WHERE b.n IS NULL OR (a.n >= 5 AND b.n < a.n * 0.8)""")
def loss_guard(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_returnflag")
    count = lambda df: df.groupBy("k").agg(F.count("*").alias("n"))
    return changes.losses(count(items), count(items.where(F.col("l_returnflag") != "A")), "k", "n")


@query("""WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS last FROM events WHERE event_id % 2 = 0 GROUP BY user_id)
SELECT e.event_id, e.user_id, e.event_type, l.last AS previous_digest FROM events e LEFT JOIN l USING (user_id) WHERE e.event_id % 2 = 1 AND e.event_type IS DISTINCT FROM l.last""")
def append_on_change(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return changes.to_append(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), "user_id", "event_id", "event_type").select("event_id", "user_id", "event_type", "previous_digest")


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def violations(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of documents that are not among the German ones."""
    docs = table(spark, sf, "documents").where("lang = 'de'")
    return changes.violations(docs, table(spark, sf, "labels").withColumnRenamed("doc_id", "ref"), "doc_id", "ref").select(F.col("ref").alias("doc_id"), "quality", "toxic")


@query("""SELECT d.doc_id, CASE WHEN c.doc_id IS NULL THEN 'missing' WHEN d.lang IS DISTINCT FROM c.lang THEN 'changed' WHEN d.source IS DISTINCT FROM c.source THEN 'source-changed' ELSE 'unchanged' END AS state FROM documents d
LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 4 = 2 THEN 'new' ELSE source END AS source FROM documents WHERE doc_id % 4 <> 3) c USING (doc_id)""")
def watch_states(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    i = F.col("doc_id") % 4
    now = docs.where(i != 3).withColumn("lang", F.when(i == 1, "xx").otherwise(F.col("lang"))).withColumn("source", F.when(i == 2, "new").otherwise(F.col("source")))
    return changes.watch_states(docs, now, "doc_id", "lang", "source").select("doc_id", "state")


@query("""WITH m AS (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 15), t AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_name || '!' END AS v FROM nation WHERE n_nationkey >= 10)
SELECT CAST(k AS VARCHAR) AS k, v FROM m UNION ALL SELECT CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.k = t.k) THEN t.k || '-copy' ELSE CAST(t.k AS VARCHAR) END, t.v FROM t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.k = t.k AND m.v = t.v)""")
def merge_entries(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    theirs = n.where("k >= 10").withColumn("v", F.when(F.col("k") % 2 == 0, F.col("v")).otherwise(F.concat("v", F.lit("!"))))
    return changes.merged_entries(n.where("k < 15"), theirs, "k", ["v"])


@query("SELECT min(doc_id) AS doc_id, text, lang FROM documents GROUP BY text, lang")
def dedup_identity(spark: SparkSession, sf: str) -> DataFrame:
    return changes.distinct_evidence(table(spark, sf, "documents").select("doc_id", "text", "lang"), ["text", "lang"], "doc_id")


@query("SELECT doc_id, text FROM documents WHERE lang = 'de' EXCEPT ALL SELECT doc_id, text FROM documents WHERE source = 'src3'")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return changes.left_over(docs.where("lang = 'de'").select("doc_id", "text"), docs.where("source = 'src3'").select("doc_id", "text"))


@query("SELECT list_sort(list_distinct(list(l_returnflag))) AS modes, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def pack_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    return aggregates.label_sets(rows, ["o_orderpriority"], "l_returnflag", "modes")
