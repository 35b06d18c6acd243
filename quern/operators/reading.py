"""What a reader sees of a law: chapters, scopes, sections of documents, lists."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.links import article_address
from quern.functions.query import Query
from quern.functions.text import normalize, normalize_text
from quern.operators.search import CENTRAL_REGION, matches
from quern.operators.windows import runs

#: The order in which places are listed, and how articles outside chapters are titled.
REGIONS = ("臺北市", "新北市", "桃園市", "臺中市", "臺南市", "高雄市", "基隆市", "新竹市", "新竹縣", "苗栗縣", "彰化縣", "南投縣", "雲林縣", "嘉義市", "嘉義縣", "屏東縣", "宜蘭縣", "花蓮縣", "臺東縣", "澎湖縣", "金門縣", "連江縣")
NO_CHAPTER = "未分章條文"
#: Place of names that no list orders.
LAST = 999


def chapter_path(path: Column) -> Column:
    """The part of a heading path that tells a chapter: up to its first 章, else its first heading."""
    at = F.array_position(F.transform(path, lambda h: h.rlike("^第[^章]*章")), True)
    return F.slice(path, F.lit(1), F.when(at > 0, at).otherwise(1).cast("int"))


def with_chapters(articles: DataFrame) -> DataFrame:
    """``articles(law_id, ord, path, ...)`` with chapter (id of the run of articles under one chapter) and chapter_title."""
    rows = articles.withColumn("quern_path", chapter_path(F.col("path")))
    rows = runs(rows, ["law_id"], ["ord"], F.col("quern_path"))
    title = F.when(F.size("quern_path") > 0, F.array_join("quern_path", " / ")).otherwise(NO_CHAPTER)
    return rows.withColumn("chapter", F.concat(F.lit("chapter-"), (F.col("run") - 1).cast("string"))).withColumn("chapter_title", title).drop("run", "quern_path")


def in_law(articles: DataFrame, query: Query) -> DataFrame:
    """Articles (no_norm, body_norm) that answer a query inside one law; all without a query."""
    if not query.text:
        return articles
    number = F.col("no_norm") == query.article if query.article else F.lit(True)
    return articles.where(number & matches(query, [F.col("no_norm"), F.col("body_norm")]))


def visible_articles(articles: DataFrame, query: Query, chapter: str = "all") -> DataFrame:
    """Articles shown: those that answer the query in any chapter; without one, those of the chapter, or all if it is unknown."""
    if query.text or chapter == "all":
        return in_law(articles, query)
    known = F.max(F.col("chapter") == chapter).over(Window.partitionBy("law_id"))
    return articles.withColumn("quern_known", known).where((F.col("chapter") == chapter) | ~F.col("quern_known")).drop("quern_known")


def print_selection(laws: DataFrame, articles: DataFrame, kind: str, value: str = "") -> DataFrame:
    """Articles to print of full-text laws without a document of their own, and the selection's label.

    ``kind``: law, chapter (``value`` its id) or article (``value`` its number).
    """
    held = laws.where((F.col("coverage") == "full") & ~F.col("has_document")).select(F.col("id").alias("law_id"))
    rows = with_chapters(articles.join(held, "law_id", "left_semi"))
    if kind == "law":
        return rows.withColumn("label", F.lit("整部法規"))
    if kind == "chapter":
        return rows.where(F.col("chapter") == value).withColumn("label", F.col("chapter_title"))
    return rows.where(article_address(F.col("no")) == re.sub("^第|[條點]$", "", normalize_text(value))).withColumn("label", F.col("no"))


def section_hits(sections: DataFrame, anchors: DataFrame, needle: str) -> DataFrame:
    """Sections (section_id, title, text) whose title or text holds the needle, with the anchor to go to.

    ``anchors``: section_id, at (order), id, text. An anchor with the needle as its id
    goes before the first whose text holds it. The needle is normalised here.
    """
    wanted = F.lit(normalize_text(needle))
    rows = sections.where((wanted != "") & F.contains(normalize(F.concat_ws(" ", "title", "text")), wanted))
    named, inside = normalize("id") == wanted, F.contains(normalize("text"), wanted)
    chosen = anchors.where(F.coalesce(named, F.lit(False)) | inside).groupBy("section_id").agg(F.min_by("at", F.struct((~F.coalesce(named, F.lit(False))).alias("later"), "at")).alias("anchor"))
    return rows.join(chosen, "section_id", "left").select("section_id", "title", "anchor")


def pages_with(pages: DataFrame, needle: str) -> DataFrame:
    """Pages whose text for searching (search_text, else text) holds the needle, both normalised."""
    wanted = F.lit(normalize_text(needle))
    return pages.where((wanted != "") & F.contains(normalize(F.coalesce("search_text", "text")), wanted))


def searchable(laws: DataFrame) -> DataFrame:
    """Laws of which something can be searched: full texts and documents."""
    return laws.where((F.col("coverage") == "full") | F.col("has_document"))


def eligible_jobs(jobs: DataFrame, sites: Sequence[str], begins: Sequence[str], holds: Sequence[str]) -> DataFrame:
    """Jobs (name, site) that are to run: not of these sites, and with none of these in their name; each (site, id) once."""
    name = F.col("name")
    bad = F.col("site").isin(list(sites))
    for b in begins:
        bad = bad | F.startswith(name, F.lit(b))
    for h in holds:
        bad = bad | F.contains(name, F.lit(h))
    w = Window.partitionBy("site", "id").orderBy(F.desc("ord"))
    return jobs.where(~bad).withColumn("quern_rn", F.row_number().over(w)).where("quern_rn = 1").drop("quern_rn")


def found_nodes(nodes: DataFrame, laws: DataFrame, needle: str) -> DataFrame:
    """Nodes of a graph whose label, or whose law's keywords, hold the needle."""
    q = F.lit(normalize_text(needle))
    words = laws.select(F.concat(F.lit("l:"), "id").alias("id"), F.array_join("keywords", " ").alias("quern_words"))
    hit = F.contains(normalize("label"), q) | F.contains(normalize(F.coalesce("quern_words", F.lit(""))), q)
    return nodes.join(words, "id", "left").where((q != "") & hit).drop("quern_words")


def resources_for(resources: DataFrame, category: str, region: str, everywhere: str = "全台", most: int | None = None) -> DataFrame:
    """Links of a category for a place: its own and the central ones; for ``everywhere`` all."""
    here = F.lit(region == everywhere) | F.col("region").isin(CENTRAL_REGION, region)
    rows = resources.where((F.col("category") == category) & here).orderBy("ord")
    return rows if most is None else rows.limit(most)


def explored_rulings(rulings: DataFrame, saved: DataFrame | None = None, topic: str | None = None, mentioned: bool = False) -> DataFrame:
    """Rulings of a topic, of a status, among the saved ones; None means any."""
    rows = rulings if saved is None else rulings.join(saved.select("id"), "id", "left_semi")
    if topic is not None:
        rows = rows.where(F.col("topic") == topic)
    return rows.where("status = 'mentioned'") if mentioned else rows


def coverage_checklist(laws: DataFrame, topics: Sequence[tuple[str, str]], mode: str, name: str = "") -> DataFrame:
    """Topics (pattern of names) and their laws in one mode: full, document, link, gaps, all; n laws, those whose name holds ``name``."""
    tests = {"full": F.col("coverage") == "full", "document": F.col("has_document"), "link": (F.col("coverage") == "link") & ~F.col("has_document")}
    every = laws.sparkSession.createDataFrame([(t, i) for i, (t, _) in enumerate(topics)], "topic string, ord int")
    labels = F.array_compact(F.array(*[F.when(F.col("name").rlike(p), F.lit(t)) for t, p in topics]))
    members = laws.select("id", "coverage", "has_document", "name", F.explode(labels).alias("topic"))
    alike = F.contains(F.translate("name", "台", "臺"), F.translate(F.lit(name.strip()), "台", "臺"))
    count = members.groupBy("topic").agg(F.count("*").alias("n_laws"), F.count_if(alike).alias("n_named"), *[F.bool_or(t).alias(f"has_{k}") for k, t in tests.items()])
    rows = every.join(count, "topic", "left").na.fill(0, ["n_laws", "n_named"]).na.fill(False)
    keep = F.col("n_laws") == 0 if mode == "gaps" else F.col(f"has_{mode}") if mode in tests else F.lit(True)
    return rows.where(keep).select("topic", "ord", "n_laws", "n_named")


def ordered_laws(laws: DataFrame, names: DataFrame) -> DataFrame:
    """Laws in their display order: central ones first, then in the order of ``names(name, ord)``, then by name."""
    rows = laws.join(names.select("name", F.col("ord").alias("list_ord")), "name", "left")
    return rows.orderBy(F.col("region") != CENTRAL_REGION, F.coalesce("list_ord", F.lit(LAST)), "name")


def ordered_regions(regions: DataFrame, name: str = "name") -> DataFrame:
    """Places with region_ord, their place in the fixed list (null if not in it)."""
    known = regions.sparkSession.createDataFrame([(r, i) for i, r in enumerate(REGIONS)], f"{name} string, region_ord int")
    return regions.join(F.broadcast(known), name, "left")  # as many rows as there are places
