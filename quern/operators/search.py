"""Search: exact matching and ranking, and the index path that gives the same result from fewer rows."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.query import Query, Term, Vocabulary
from quern.functions.text import excerpt, grams, normalize_text, occurrences
from quern.sinks.scratch import checkpointed

#: Points of a hit, and the place whose laws hold everywhere.
ARTICLE, SECTION, NAMED, TITLE, PHRASE, CENTRAL = 100, 350, 170, 35, 50, 3
CENTRAL_REGION = "中央"
#: Fixed values of the relevance of a text: its upper end and spread; points for covered topics and density; saturation of
#: counts and how the text's size enters; characters of the lead, points for a word there and at the very start; a definition.
MOST_RELEVANT, SPREAD, COVERAGE, DENSITY = 34, 40, 15, 10
SATURATION, SHORT_SHARE, LENGTH_SHARE, TYPICAL_SIZE = 1.2, 0.25, 0.75, 400
LEAD, EARLY, FIRST_WORD, DEFINITION_SIZE, DEFINES = 90, 15, 30.0, 180, 100.0


def term_score(term: Term, fields: list[Column]) -> Column:
    """2 if the term or its full name is in a field, 1 if all words it is made of are, else 0."""
    literal = reduce(or_, [F.contains(f, F.lit(w)) for f in fields for w in dict.fromkeys((term.literal, term.value))])
    out = F.when(literal, 2)
    if term.parts:
        out = out.when(reduce(and_, [reduce(or_, [F.contains(f, F.lit(p)) for f in fields]) for p in term.parts]), 1)
    return out.otherwise(0)


def matches(query: Query, fields: list[Column]) -> Column:
    """Whether every term matches; true for a query without terms."""
    return reduce(and_, [term_score(t, fields) > 0 for t in query.terms], F.lit(True))


def phrase(query: Query, fields: list[Column]) -> Column:
    return reduce(and_, [term_score(t, fields) == 2 for t in query.terms], F.lit(True))


def topics(query: Query) -> list[list[str]]:
    """Groups of synonyms, one for each thing the query asks about."""
    return [[p] for t in query.terms for p in t.parts] + [list(dict.fromkeys((t.literal, t.value))) for t in query.terms if not t.parts]


def topic_tests(groups: list[list[str]], name: Column, region: Column) -> list[Column]:
    """For each group whether it is a topic of a law's articles: words that are the law's name or its place only say which law is meant."""

    def place(word: str) -> Column:
        begins = F.startswith(region, F.lit(word)) & (region != CENTRAL_REGION) if len(word) >= 2 else F.lit(False)
        return (name == word) | (region == word) | begins

    return [~F.coalesce(reduce(or_, [place(w) for w in g]), F.lit(False)) for g in groups]


SIGNALS = "found double, density double, lead double, definition double"


def word_signals(body: Column, word: str, every: Callable[[Column], Column]) -> Column:
    """Struct of one word's signals in a text; ``every`` says whether a definition's text has a word of each topic."""
    label = f"((?:^|[、;。:]){re.escape(word)}(?:[:]|(?:,)?(?:係指|指|意指))[\\s\\S]*)"

    def judged(s: Column) -> Column:
        lead_end = F.when(s["stop"] < 0, LEAD).otherwise(F.least(F.lit(LEAD), s["stop"]))
        defined = F.when(F.contains(s["label"], F.lit("。")), F.substring_index(s["label"], "。", 1)).otherwise(F.left(s["label"], F.lit(DEFINITION_SIZE)))
        return F.struct(
            F.lit(1.0).alias("found"),
            (s["n"] / (s["n"] + SATURATION * (SHORT_SHARE + LENGTH_SHARE * s["size"] / TYPICAL_SIZE))).alias("density"),
            F.when(s["at"] == 0, FIRST_WORD).when(s["at"] < lead_end, EARLY * (1 - s["at"] / LEAD)).otherwise(0.0).alias("lead"),
            F.when((s["label"] != "") & every(defined), DEFINES).otherwise(0.0).alias("definition"),
        )

    facts = F.struct(
        (F.instr(body, word) - 1).alias("at"), (F.instr(body, "。") - 1).alias("stop"), occurrences(body, word).cast("double").alias("n"), F.length(body).alias("size"),
        (F.regexp_extract(body, label, 1) if len(word) >= 2 else F.lit("")).alias("label"),
    )
    nothing = F.struct(*[F.lit(0.0).alias(k) for k in ("found", "density", "lead", "definition")])
    return F.when(F.contains(body, F.lit(word)), F.transform(F.array(facts), judged)[0]).otherwise(nothing).cast(f"struct<{SIGNALS.replace(' double', ': double')}>")


def relevance(body: Column, groups: list[list[str]], active: list[Column] | None = None) -> Column:
    """0 to 34: how much of the topics a text covers, how densely, how early, and whether it defines them.

    ``active`` says for each group whether it counts in a row; without it all do.
    """
    if not groups:
        return F.lit(0.0)
    active = active or [F.lit(True)] * len(groups)
    every = lambda t: reduce(and_, [~on | reduce(or_, [F.contains(t, F.lit(w)) for w in g]) for on, g in zip(active, groups, strict=True)])
    n = reduce(lambda a, b: a + b, [on.cast("int") for on in active])

    def total(s: Column) -> Column:
        sums = []
        for part, weight in (("found", COVERAGE), ("density", DENSITY), ("lead", 1.0), ("definition", 1.0)):
            at, best = 0, []
            for on, g in zip(active, groups, strict=True):
                words = [s[at + k][part] for k in range(len(g))]
                at += len(g)
                best.append(F.when(on, F.greatest(*words) if len(words) > 1 else words[0]).otherwise(0.0))
            sums.append(weight * reduce(lambda a, b: a + b, best) / n)
        return MOST_RELEVANT * (1 - F.exp(-reduce(lambda a, b: a + b, sums) / SPREAD))

    signals = F.array(*[word_signals(body, w, every) for g in groups for w in g])  # once for each word, then added up
    return F.when(n == 0, 0.0).otherwise(F.transform(F.array(signals), total)[0])


def title_hits(laws: DataFrame, query: Query) -> DataFrame:
    """Laws whose name, region, id or keywords answer the whole query, with their score.

    ``laws``: id, name_norm, region_norm, id_norm, keywords_norm (array).
    """
    fields = law_fields()
    exact = F.lit(False)
    if len(query.terms) == 1:
        t = query.terms[0]
        exact = F.col("name_norm").isin(t.value, t.literal) | (F.col("id_norm") == t.literal)
    literal = reduce(or_, [term_score(t, [F.col("name_norm")]) == 2 for t in query.terms], F.lit(False))
    return laws.where(matches(query, fields)).withColumn("score", F.when(exact, 600.0).when(literal, 400.0).otherwise(240.0))


def search(laws: DataFrame, articles: DataFrame, query: Query, vocabulary: Vocabulary | None = None, article_mode: bool = False, candidates: DataFrame | None = None) -> DataFrame:
    """Laws and articles that answer a query, best first.

    ``laws`` as in ``title_hits`` with ``ord`` and ``region``; ``articles``: law_id, ord,
    no, no_norm, text, body_norm. A law that answers by its title alone stands for its
    articles. ``candidates`` (law_id, no) restricts articles before they are read, and
    never changes the result if it holds all that can match. Returned: law_id, no (null
    for a law), type, score, excerpt, match; order by score, then law and article order.
    """
    vocabulary = vocabulary or Vocabulary()
    if not query.text:
        return articles.select("law_id", "no", F.lit("").alias("type"), F.lit(0.0).alias("score"), F.lit("").alias("excerpt"), F.lit("").alias("match")).limit(0)
    fields = law_fields()
    named = [t for t in query.terms if vocabulary.named(t)] if query.article else []
    if named:  # only those that name some law bind the search
        seen = laws.agg(*[F.max(term_score(t, [F.col("name_norm")])).alias(f"n{i}") for i, t in enumerate(named)]).first()
        named = [t for i, t in enumerate(named) if seen[f"n{i}"]]
    scoped = laws.where(reduce(and_, [term_score(t, [F.col("name_norm")]) > 0 for t in named], F.lit(True)))
    by_title = matches(query, fields)
    heads = title_hits(scoped, query).select(F.col("id").alias("law_id"), F.lit(None).cast("string").alias("no"), F.lit("laws").alias("type"), "score", F.lit(None).cast("string").alias("excerpt"), F.lit(None).cast("string").alias("match"), F.col("ord").alias("law_ord"), F.lit(-1).alias("ord"))
    rows = articles if candidates is None else articles.join(candidates, ["law_id", "no"], "left_semi")
    if query.article:
        rows, heads = rows.where(F.col("no_norm") == query.article), heads.limit(0)
    elif article_mode:
        heads = heads.limit(0)
    else:
        scoped = scoped.where(~by_title)
    joined = rows.join(scoped.select(F.col("id").alias("law_id"), F.col("ord").alias("law_ord"), "region", "name_norm", "region_norm", "id_norm", "keywords_norm"), "law_id")
    every = [*fields, F.col("body_norm")]
    whole, groups = phrase(query, every), topics(query)
    score = (
        F.lit(float(SECTION if query.article else ARTICLE)) + (NAMED if named else 0) + F.when(by_title, TITLE).otherwise(0) + F.when(whole, PHRASE).otherwise(0)
        + relevance(F.col("body_norm"), groups, topic_tests(groups, F.col("name_norm"), F.col("region_norm"))) + F.when(F.col("region") == CENTRAL_REGION, CENTRAL).otherwise(0)
    )
    hits = joined.where(matches(query, every)).select("law_id", "no", F.lit("articles").alias("type"), score.alias("score"), excerpt(F.col("text"), query.words).alias("excerpt"), F.when(whole, "phrase").otherwise("keywords").alias("match"), "law_ord", "ord")
    return heads.unionByName(hits).orderBy(F.desc("score"), "law_ord", "ord").drop("law_ord", "ord")


def search_rulings(rulings: DataFrame, query: Query, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Rulings that answer a query; exact numbers first, then title and phrase matches.

    ``rulings``: id, ord, number_norm, number_key, title_norm, body_norm, topic_norm,
    unit_norm, refs (array of law, article_norm, evidence_norm).
    """
    vocabulary = vocabulary or Vocabulary()
    fields = [F.col(c) for c in ("number_norm", "number_key", "title_norm", "body_norm", "topic_norm", "unit_norm")]
    rows = rulings.where(matches(query, fields)) if query.text else rulings.limit(0)
    if query.article:
        named = [t for t in query.terms if vocabulary.named(t)]
        rows = rows.where(F.exists("refs", lambda r: reduce(and_, [term_score(t, [r["evidence_norm"]]) > 0 for t in named], r["article_norm"] == query.article)))
    number = F.when((F.col("number_key") == query.text) | (F.col("number_norm") == query.text), 1000).when(F.contains("number_norm", F.lit(query.text)), 500).otherwise(0)
    title = F.when(F.lit(bool(query.terms)) & matches(query, [F.col("title_norm")]), 100).otherwise(0)
    return rows.withColumn("score", number + title + F.when(phrase(query, fields), 20).otherwise(0)).orderBy(F.desc("score"), "ord")


def recent_rulings_first(rulings: DataFrame, score: str = "score") -> DataFrame:
    """Best score first, then by the date of issue (or else of publication), latest first."""
    day = F.coalesce(F.nullif("date", F.lit("")), "published", F.lit(""))
    return rulings.orderBy(F.desc(score), F.desc(day), "ord")


@functools.lru_cache(maxsize=65536)
def normal_length(char: str) -> int:
    """Characters that one character becomes in the normal form."""
    return len(normalize_text(char))


def page_excerpts(text: Column, at: Column, size: int = 220, before: int = 25) -> Column:
    """``size`` characters of a page from a little before the place ``at`` of its normalised text, white space run together.

    Characters change their number when they are normalised, so the place is found again in the page itself.
    """

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series, places: pd.Series) -> pd.Series:
        def one(t: str | None, place: int) -> str | None:
            if t is None:
                return None
            reached = itertools.accumulate(map(normal_length, t), initial=0)
            first = next((i for i, n in enumerate(reached) if n >= place), len(t))
            start = max(0, first - before)
            return f"{'…' if start else ''}{re.sub(r'\s+', ' ', t[start : start + size])}{'…' if len(t) > start + size else ''}"

        return pd.Series([one(t, p) for t, p in zip(texts, places, strict=True)], dtype=object)

    return cut(text, at)


def first_place(text: Column, words: list[str]) -> Column:
    """Where the first of ``words`` stands in ``text``, from 0; 0 if none does."""
    found = [F.nullif(F.instr(text, w), F.lit(0)) for w in words]
    return F.coalesce(F.least(*found, F.lit(None).cast("int")), F.lit(1)) - 1 if found else F.lit(0)


def search_pages(pages: DataFrame, query: Query, fields: list[Column] | None = None) -> DataFrame:
    """Document pages (text, body_norm, ...) that answer a query, with score, match and excerpt."""
    every = [*(fields or []), F.col("body_norm")]
    hit = F.lit(bool(query.text)) & matches(query, every) & (F.contains("body_norm", F.lit(query.article)) if query.article else F.lit(True))
    whole = phrase(query, every)
    score = F.lit(float(ARTICLE + (2 * ARTICLE if query.article else 0))) + F.when(whole, PHRASE).otherwise(0)
    return pages.where(hit).select("*", score.alias("score"), F.when(whole, "phrase").otherwise("keywords").alias("match"), page_excerpts(F.col("text"), first_place(F.col("body_norm"), query.words)).alias("excerpt"))


def law_fields() -> list[Column]:
    """A law's searched columns; keywords stay apart from one another."""
    return [F.col("name_norm"), F.col("region_norm"), F.col("id_norm"), F.array_join("keywords_norm", "\n")]


def search_documents(laws: DataFrame, pages: DataFrame, query: Query) -> DataFrame:
    """Pages of laws' documents that answer a query: law_id, page, type, score, match, excerpt.

    ``pages``: law_id, page, text, body_norm. A page may answer some words by its law's name.
    """
    rows = pages.join(laws.select(F.col("id").alias("law_id"), "name_norm", "region_norm", "id_norm", "keywords_norm"), "law_id")
    return search_pages(rows, query, law_fields()).select("law_id", "page", F.lit("documents").alias("type"), "score", "match", "excerpt")


def indexed_search(laws: DataFrame, articles: DataFrame, pages: DataFrame, article_index: DataFrame, page_index: DataFrame, query: Query, vocabulary: Vocabulary | None = None, article_mode: bool = False) -> DataFrame:
    """Articles, laws and document pages in one ranked result, read through the index.

    ``article_index`` (law_id, no, gram) and ``page_index`` (law_id, page, gram) pick
    candidates; the exact search then verifies these, so the result is that of a scan. An
    article number restricts articles, not pages. Order: score, then laws and articles in
    their order, then pages.
    """
    found = candidate_rows(article_index, ["law_id", "no"], query)
    hits = search(laws, articles, query, vocabulary, article_mode, found)
    some = candidate_rows(page_index, ["law_id", "page"], query)
    rows = pages if some is None else pages.join(some, ["law_id", "page"], "left_semi")
    return hits.unionByName(search_documents(laws, rows, query), allowMissingColumns=True).orderBy(F.desc("score"))


def indexed_rulings(rulings: DataFrame, index: DataFrame, query: Query, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Rulings that answer a query, read through ``index(id, gram)``; the same as ``search_rulings`` on all."""
    found = candidate_rows(index, ["id"], query)
    rows = rulings if found is None else rulings.join(found, "id", "left_semi")
    if query.article:
        rows = rows.where(F.exists("refs", lambda r: r["article_norm"] == query.article))
    return search_rulings(rows, query, vocabulary)


def ranked(hits: DataFrame, *order: Column, rank: str = "rank") -> DataFrame:
    """Adds each row's place from 1 in the given order, without bringing all rows to one task.

    Rows are split into ranges of the order and numbered there; only one count a range meets the others.
    """
    rows = checkpointed(hits.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("quern_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("quern_part").orderBy(*order)
    before = Window.orderBy("quern_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    counts = rows.groupBy("quern_part").agg(F.count("*").alias("quern_n")).select("quern_part", F.coalesce(F.sum("quern_n").over(before), F.lit(0)).alias("quern_before"))
    return rows.withColumn(rank, F.row_number().over(inside)).join(F.broadcast(counts), "quern_part").withColumn(rank, (F.col(rank) + F.col("quern_before")).cast("long")).drop("quern_part", "quern_before")


def grouped_hits(hits: DataFrame, group: str, rank: str) -> DataFrame:
    """Laws of the hits in the order of their best one: group, first_rank, n, title_hit. Their hits stay rows of ``hits``."""
    return hits.groupBy(group).agg(F.min(rank).alias("first_rank"), F.count("*").alias("n"), F.bool_or(F.col("type") == "laws").alias("title_hit"))


def with_supplement(hits: DataFrame, more: DataFrame, group: str, part: str, rank: str) -> DataFrame:
    """``hits`` and those of ``more`` whose group is among them, each part of a group once, the best first.

    Ranks of ``more`` follow after those of ``hits``; no new group comes in.
    """
    known = more.join(hits.select(group).distinct(), group, "left_semi").withColumn("quern_later", F.lit(True))
    both = hits.withColumn("quern_later", F.lit(False)).unionByName(known)
    w = Window.partitionBy(group, part).orderBy("quern_later", rank)
    return both.withColumn("quern_rn", F.row_number().over(w)).where("quern_rn = 1").drop("quern_rn", "quern_later")


def postings(rows: DataFrame, key: list[str], fields: list[Column]) -> DataFrame:
    """Inverted index in long form: gram and the row's key, each once."""
    every = F.array_distinct(F.flatten(F.array(*[grams(f) for f in fields])))
    return rows.select(*key, F.explode_outer(every).alias("gram")).where("gram is not null")


def document_frequencies(index: DataFrame) -> DataFrame:
    """How many rows each gram of an index occurs in: gram, df."""
    return index.groupBy("gram").agg(F.count("*").alias("df"))


def reach(rows: DataFrame, candidates: DataFrame, key: list[str]) -> DataFrame:
    """One row: how many rows an index leaves to be read, of how many."""
    told = rows.select(*key).join(candidates.select(*key, F.lit(True).alias("quern_read")), key, "left")
    return told.agg(F.count("quern_read").alias("candidates"), F.count("*").alias("documents"))


def phrase_rows(index: DataFrame, key: list[str], word: str) -> DataFrame:
    """Keys of rows that hold every gram of ``word``: the word's only character, or all its pairs."""
    wanted = [word] if len(word) == 1 else list(dict.fromkeys(word[i : i + 2] for i in range(len(word) - 1)))
    found = index.where(F.col("gram").isin(wanted))
    if len(wanted) == 1:
        return found.select(*key)
    return found.groupBy(*key).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).select(*key)


def candidate_rows(index: DataFrame, key: list[str], query: Query) -> DataFrame | None:
    """Keys that may match: for each term its literal, its full name or all its words. None if the query has no terms."""
    every = None
    for t in query.terms:
        some = [phrase_rows(index, key, w) for w in dict.fromkeys((t.literal, t.value))]
        if t.parts:
            some.append(reduce(lambda a, b: a.join(b, key, "left_semi"), [phrase_rows(index, key, p) for p in t.parts]))
        either = reduce(lambda a, b: a.union(b), some).distinct()
        every = either if every is None else every.join(either, key, "left_semi")
    return every


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row of each key in the given order."""
    return df.withColumn("quern_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("quern_rn = 1").drop("quern_rn")
