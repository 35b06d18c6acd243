"""Projections and checks around documents: canonical rows, evidence, references, sections, completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.numerals import address
from quern.functions.text import normalize
from quern.operators.joins import with_fallback

#: Numerals that serial numbers are written with.
SERIAL = "[0-9０-９一二三四五六七八九〇零○]{5,}號"
FROM, TO = "０１２３４５６７８９〇零○一二三四五六七八九", "0123456789000123456789"


def canonical(laws: DataFrame, volatile: Sequence[str] = ("retrieved", "snapshot", "note", "schemaVersion", "contentHash", "sourceRecordId", "version")) -> DataFrame:
    """What counts as a law's content: columns in the order of their names, without those that change by themselves."""
    return laws.select(*sorted(c for c in laws.columns if c not in volatile))


def enriched_articles(articles: DataFrame) -> DataFrame:
    """Adds address, id, anchor and content hash to ``articles(law_id, no, text)``."""
    a = articles.withColumn("address", address(normalize("no")))
    return a.withColumn("id", F.concat("law_id", F.lit("/a:"), "address")).withColumn("anchor", F.concat(F.lit("a-"), "address")).withColumn("content_hash", F.sha2("text", 256))


def citation_targets(articles: DataFrame, units: DataFrame) -> DataFrame:
    """What can be cited in each article: law_id, no, and the number of items of each paragraph."""
    items = units.where("kind = 'item'").groupBy("law_id", "no", F.col("parent_id").alias("unit_id")).agg(F.count("*").alias("items"))
    paragraphs = units.where("kind = 'paragraph'").join(items, ["law_id", "no", "unit_id"], "left")
    counts = paragraphs.groupBy("law_id", "no").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", F.coalesce("items", F.lit(0)).alias("items")))), lambda s: s["items"]).alias("items"))
    return articles.select("law_id", "no").join(counts, ["law_id", "no"], "left")


def outside_only(context: DataFrame) -> DataFrame:
    """Declarations that come from another law than their own."""
    return context.where("source_law <> law_id")


def evidence(rows: DataFrame, kind: str, quote: Column, limit: int = 24_000, **locator: Column) -> DataFrame:
    """Citable evidence: kind, locator, quote cut at ``limit``, whether it was cut, and the whole quote's hash."""
    places = F.struct(*[v.cast("string").alias(k) for k, v in locator.items()])
    return rows.select(F.lit(kind).alias("kind"), places.alias("locator"), F.left(quote, F.lit(limit)).alias("quote"), (F.length(quote) > limit).alias("cut"), F.sha2(quote, 256).alias("content_hash"))


def unit_text(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start + 1, end - start)


def keyword_union(laws: DataFrame, extra: DataFrame, key: str, words: str) -> DataFrame:
    """``laws`` with the words of ``extra`` after their own, each once."""
    more = extra.select(key, F.col(words).alias("quern_words"))
    return laws.join(more, key, "left").withColumn(words, F.array_union(F.coalesce(words, F.array().cast("array<string>")), F.coalesce("quern_words", F.array().cast("array<string>")))).drop("quern_words")


def serial_numbers(text: Column) -> Column:
    """Serial numbers (five numerals or more before 號) in Arabic digits, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(SERIAL), F.lit(0)), lambda s: F.regexp_replace(F.translate(s, FROM, TO), "號$", "")))


def serial_links(texts: DataFrame, key: str, text: str, numbers: DataFrame) -> DataFrame:
    """(key, id): rulings whose unique number (``numbers(number_key, id)``) a text mentions, itself left out."""
    found = texts.select(key, F.explode(serial_numbers(F.col(text))).alias("number_key"))
    return found.join(numbers, "number_key").where(F.col(key) != F.col("id")).select(key, "id").distinct()


def related_rulings(refs: DataFrame, law: str, article: str, ruling: str) -> DataFrame:
    """Distinct rulings of each article as rows: law, article, ruling."""
    return refs.select(law, article, ruling).distinct()


def sectioned_lines(lines: DataFrame, key: str, order: Sequence[str], text: str, heading: str) -> DataFrame:
    """Lines with the heading above them and the number of their section; lines before the first heading are section 0."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_head = F.col(text).rlike(heading)
    return lines.withColumn("heading", F.last(F.when(is_head, F.col(text)), ignorenulls=True).over(w)).withColumn("section", F.count_if(is_head).over(w))


def joined_paragraphs(lines: DataFrame, key: str, order: str, text: str, heading: str, ends: str = "[。；：:;!?]$") -> DataFrame:
    """Paragraphs that lines make up, across page breaks too: key, at (order of the first line), heading (of the section), text.

    A line begins a paragraph if it is a heading, follows one, or follows a line that ends
    a sentence; headings are paragraphs of their own.
    """
    w = Window.partitionBy(key).orderBy(order)
    is_head = F.col(text).rlike(heading)
    before = F.lag(text).over(w)
    begins = F.when(is_head | before.isNull() | before.rlike(ends) | before.rlike(heading), 1).otherwise(0)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("quern_begins", begins).withColumn("quern_heading", F.last(F.when(is_head, F.col(text)), ignorenulls=True).over(so_far))
    rows = rows.withColumn("quern_n", F.sum("quern_begins").over(so_far))
    parts = rows.groupBy(key, "quern_n").agg(F.min(order).alias("at"), F.first("quern_heading").alias("heading"), F.array_sort(F.collect_list(F.struct(order, text))).alias("parts"))
    return parts.select(key, "at", "heading", F.array_join(F.transform("parts", lambda p: p[text]), "").alias("text"))


def section_of(pages: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """Each page with the section (start_page..end_page) that holds it, or the key's first section."""
    first = sections.groupBy(key).agg(F.min_by("section_id", "start_page").alias("first_section"))
    p, s = pages.alias("p"), sections.alias("s")
    on = (F.col(f"p.{key}") == F.col(f"s.{key}")) & F.col("p.page").between(F.col("s.start_page"), F.col("s.end_page"))
    return p.join(s, on, "left").select("p.*", F.col("s.section_id").alias("found")).join(first, key, "left").withColumn("section_id", F.coalesce("found", "first_section")).drop("found", "first_section")


def outline(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages that begin with a chapter or appendix heading, with their first line as title."""
    starts = F.col(text).rlike(r"^\s*(第\s*[0-9一二三四五六七八九十]+\s*[章編]|附錄)")
    return pages.where(starts).withColumn("title", F.trim(F.split_part(F.ltrim(text), F.lit("\n"), F.lit(1))))


def without_footers(words: DataFrame, top: str = "top", text: str = "text", below: float = 760) -> DataFrame:
    """Words of a page without its printed number: digits alone near the lower edge."""
    return words.where(~((F.col(top) > below) & F.col(text).rlike(r"^-?\s*\d{1,4}\s*-?$")))


def compared(saved: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """State of saved evidence: gone, text-changed, source-changed or same."""
    now = current.select(key, F.col("content_hash").alias("now"), F.col("source_hash").alias("source_now"))
    state = F.when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("content_hash"), "text-changed").when(~F.col("source_now").eqNullSafe(F.col("source_hash")), "source-changed").otherwise("same")
    return saved.join(now, key, "left").withColumn("state", state)


def gaps(rows: DataFrame, key: str, text: str, start: str, end: str) -> DataFrame:
    """Parts of each text that no span covers: key, gap_start, gap_end, gap."""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("quern_from", F.coalesce(F.max(end).over(w), F.lit(0))).select(key, text, F.col("quern_from").alias("gap_start"), F.col(start).alias("gap_end"))
    last = rows.groupBy(key, text).agg(F.max(end).alias("gap_start")).select(key, text, "gap_start", F.length(text).alias("gap_end"))
    return inner.unionByName(last).where("gap_start < gap_end").select(key, "gap_start", "gap_end", F.substr(text, F.col("gap_start") + 1, F.col("gap_end") - F.col("gap_start")).alias("gap"))


def mismatches(a: DataFrame, b: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys whose columns differ between two extractions of the same source, with the names of those columns."""
    other = b.select(*key, *[F.col(c).alias(f"quern_{c}") for c in columns])
    names = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"quern_{c}")), F.lit(c)) for c in columns]))
    return a.join(other, list(key), "full_outer").select(*key, names.alias("differ")).where(F.size("differ") > 0)


def archive_stats(rulings: DataFrame) -> DataFrame:
    """One row: how many rulings, how many with references, citations and attachments, and how many numbers there are."""
    return rulings.agg(F.count("*").alias("n"), F.count_if(F.size("refs") > 0).alias("with_refs"), F.sum(F.size("refs")).alias("n_refs"), F.sum(F.size("citations")).alias("n_citations"), F.count_distinct("number_key").alias("n_numbers"))


def coverage_share(rows: DataFrame, missing: Column, *group: str) -> DataFrame:
    """How complete a result is: rows asked for, and rows that could not be read."""
    return rows.groupBy(*group).agg(F.count("*").alias("candidates"), F.count_if(missing).alias("missing"))


def search_fields(laws: DataFrame) -> DataFrame:
    """The texts that a law is found by, normalised: id, fields (name, region, id and each keyword)."""
    return laws.select("id", F.concat(F.array(normalize("name"), normalize("region"), normalize("id")), F.transform(F.split(normalize(F.array_join("keywords", "|")), "[|]"), lambda k: k)).alias("fields")).select("id", F.filter("fields", lambda f: f != "").alias("fields"))


def enriched_laws(laws: DataFrame, ledger: DataFrame, sources: DataFrame) -> DataFrame:
    """Laws with their version: content hash of what counts, the one before, when it was observed, and their source's hash.

    ``ledger``: id, content_hash, previous_hash, observed_at; ``sources``: key, sha256. A law
    without a source of its own takes that of its bulk file (bulk_key).
    """
    keep = [c for c in canonical(laws).columns if c != "bulk_key"]
    rows = laws.withColumn("content_hash", F.sha2(F.to_json(F.struct(*keep), {"ignoreNullFields": "false"}), 256))
    rows = with_fallback(rows, sources, "id", "bulk_key", "key", "sha256").withColumnRenamed("sha256", "source_hash")
    told = ledger.select("id", F.col("content_hash").alias("quern_hash"), "previous_hash", "observed_at")
    same = F.col("content_hash") == F.col("quern_hash")
    rows = rows.join(told, "id", "left").withColumn("previous_hash", F.when(same, F.col("previous_hash")).otherwise(F.col("quern_hash")))
    return rows.withColumn("observed_at", F.when(same, F.col("observed_at"))).drop("quern_hash")


def current_texts(saved: DataFrame, articles: DataFrame, units: DataFrame, rulings: DataFrame, pages: DataFrame) -> DataFrame:
    """The current text behind saved evidence, by what kind of place it names: id, content_hash, source_hash.

    ``saved``: id, kind, law, article, unit, ruling, page; ``articles``: law_id, no, text,
    source_hash; ``units``: unit_id, quote; ``rulings``: id, body; ``pages``: law_id, page, text, source_hash.
    """
    none = F.lit(None).cast("string")
    a = saved.where("kind = 'article' and unit is null").select("id", F.col("law").alias("law_id"), F.col("article").alias("no")).join(articles, ["law_id", "no"]).select("id", F.col("text").alias("quote"), "source_hash")
    u = saved.where("kind = 'article' and unit is not null").select("id", F.col("unit").alias("unit_id"), F.col("law").alias("law_id")).join(units.select("unit_id", "quote"), "unit_id").join(articles.select("law_id", "source_hash").distinct(), "law_id", "left").select("id", "quote", "source_hash")
    r = saved.where("kind = 'ruling'").select("id", F.col("ruling").alias("rid")).join(rulings.select(F.col("id").alias("rid"), "body"), "rid").select("id", F.col("body").alias("quote"), none.alias("source_hash"))
    p = saved.where("kind = 'document'").select("id", F.col("law").alias("law_id"), "page").join(pages, ["law_id", "page"]).select("id", F.col("text").alias("quote"), "source_hash")
    return a.unionByName(u).unionByName(r).unionByName(p).select("id", F.sha2("quote", 256).alias("content_hash"), "source_hash")


def unexplained_gaps(found: DataFrame, headings: DataFrame, key: str) -> DataFrame:
    """Gaps (key, gap) between parsed parts that are no heading of their text (``headings(key, heading)``), white space apart."""
    rows = found.withColumn("quern_gap", F.regexp_replace("gap", r"\s+", "")).where("quern_gap <> ''")
    known = headings.select(key, F.regexp_replace("heading", r"\s+", "").alias("quern_gap"))
    return rows.join(known, [key, "quern_gap"], "left_anti").drop("quern_gap")


def in_order(texts: DataFrame, parts: DataFrame, key: str, text: str, part: str, order: str) -> DataFrame:
    """Whether a text holds its parts one after the other, white space apart, and how much of it lies outside them: key, complete, outside."""
    squash = lambda c: F.regexp_replace(c, r"\s+", "")
    own = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, squash(F.col(part)).alias("p")))), lambda s: s["p"]).alias("parts"))  # of one text
    rows = texts.select(key, squash(F.col(text)).alias("t")).join(own, key)
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("held"), F.lit(True).alias("ok"))

    def step(acc: Column, p: Column) -> Column:
        at = F.call_function("locate", p, F.col("t"), acc["at"])
        return F.struct((at + F.length(p)).alias("at"), (acc["held"] + F.length(p)).alias("held"), (acc["ok"] & (at > 0)).alias("ok"))

    walked = F.aggregate("parts", start, step)
    return rows.select(key, walked.alias("w"), F.length("t").alias("n")).select(key, F.col("w.ok").alias("complete"), F.when(F.col("w.ok"), F.col("n") - F.col("w.held")).alias("outside"))


def units_by_id(articles: DataFrame, units: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Units with these ids that lie inside their article: law_id, no, unit_id, start, end, quote."""
    rows = units.where(F.col("unit_id").isin(list(ids))).join(articles.select("law_id", "no", "text"), ["law_id", "no"])
    inside = (F.col("start") >= 0) & (F.col("end") <= F.length("text")) & (F.col("end") > F.col("start"))
    return rows.where(inside).select("law_id", "no", "unit_id", "start", "end", unit_text(F.col("text"), F.col("start"), F.col("end")).alias("quote"))


def embedded(selectors: DataFrame, articles: DataFrame, rulings: DataFrame) -> DataFrame:
    """Evidence that selectors (kind, law, article, ruling) ask for: kind, key (law or ruling), quote, content_hash.

    ``articles``: law_id, address, text; ``rulings``: id, body. Texts without words are no evidence.
    """
    by_article = selectors.where("kind = 'article'").select(F.col("law").alias("law_id"), address(normalize("article")).alias("address"))
    found = by_article.join(articles, ["law_id", "address"]).select(F.lit("article").alias("kind"), F.col("law_id").alias("key"), F.col("text").alias("quote"))
    letters = selectors.where("kind = 'ruling'").select(F.col("ruling").alias("id")).join(rulings, "id").select(F.lit("ruling").alias("kind"), F.col("id").alias("key"), F.col("body").alias("quote"))
    return found.unionByName(letters).where(F.trim("quote") != "").withColumn("content_hash", F.sha2("quote", 256))


def in_buckets(rulings: DataFrame, key: str, size: int = 256) -> DataFrame:
    """Rulings with the bucket of their numeric id and their place in it by that number."""
    number = F.col(key).cast("long")
    rows = rulings.withColumn("bucket", F.floor(number / size).cast("long"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(F.col(key).cast("long"))).cast("long"))
