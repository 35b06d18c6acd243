"""Citations and definitions: spans found row by row, resolved with joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.chains import clean_name, kind_of
from quern.functions.segmenting import LAW_NAME, at_boundary, citations, definitions, spans, term_spans, text_blocks, unit_targets, units
from quern.functions.text import normalize
from quern.operators import scopes

#: Members of a range at most; longer ones are rejected.
MOST = 20
SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"
#: How a law's first article says under which other law it is made, and how the general part of rules in volumes is named.
ENACTED = "^本(自治條例|自治規則|條例|規則|辦法|細則|準則|要點|基準|注意事項|標準|通則|規程|規範|編|法)\\s*(?:依據|依照|依)\\s*(\\p{IsHan}{2,60}?)(?:第[^。\\n]{0,90})?規定(?:訂定|訂之|制定)"
GENERAL_PART, VOLUME = "規則總則編", "^(.*規則).*編$"


def name_register(laws: DataFrame) -> DataFrame:
    """(name, law_id) of names, normalised and without dates, that belong to one law only."""
    names = laws.select(F.col("id").alias("law_id"), normalize("name").alias("full")).select("law_id", F.explode(F.array_distinct(F.array("full", clean_name(F.col("full"))))).alias("name"))
    return names.groupBy("name").agg(F.count_distinct("law_id").alias("n"), F.min("law_id").alias("law_id")).where("n = 1").select("name", "law_id")


def owns(token: Column, kind: Column, name: Column) -> Column:
    """Whether 本X in a law means the law itself."""
    return F.when(token == "本法", kind == "法律").otherwise(F.endswith(name, F.substr(token, F.lit(2))))


def tails(name: Column) -> Column:
    """Every ending of a name, itself included."""
    return F.when(F.length(name) > 0, F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substr(name, i))).otherwise(F.array().cast("array<string>"))


def declared_aliases(articles: DataFrame, laws: DataFrame) -> DataFrame:
    """(law_id, alias, alias_law): short names that a law's first article gives to another law, if each stands for one only."""
    pattern = F.lit("(\\p{IsHan}{2,40})[（(]\\s*(?:以下)?(?:簡|逕)?稱(?:為)?\\s*(\\p{IsHan}{2,16})\\s*[）)]")
    first = articles.where("ord = 0").select("law_id", F.explode(F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(1)).alias("long"), F.regexp_extract_all("text", pattern, F.lit(2)).alias("short"))).alias("d"))
    each = first.select("law_id", F.col("d.short").alias("alias"), F.explode(tails(F.col("d.long"))).alias("tail"))
    found = each.select("law_id", "alias", normalize("tail").alias("name")).join(name_register(laws).withColumnRenamed("law_id", "alias_law"), "name")
    best = found.groupBy("law_id", "alias").agg(F.max_by("alias_law", F.length("name")).alias("alias_law"), F.count_distinct("alias_law").alias("n"))
    return best.where("n = 1").select("law_id", "alias", "alias_law")


def declared_bases(articles: DataFrame, laws: DataFrame) -> DataFrame:
    """(law_id, alias, alias_law): what 本法 or the like means in a law whose first article says that it is made under another."""
    first = articles.where("ord = 0").select("law_id", F.regexp_extract("text", ENACTED, 1).alias("own"), F.regexp_extract("text", ENACTED, 2).alias("under"))
    me = laws.select(F.col("id").alias("law_id"), "kind", clean_name(normalize("name")).alias("own_name"))
    rows = first.where("own <> ''").join(me, "law_id").where(owns(F.concat(F.lit("本"), "own"), F.col("kind"), F.col("own_name")))
    parents = name_register(laws).withColumnRenamed("law_id", "alias_law")
    return rows.join(parents, normalize("under") == F.col("name")).where("alias_law <> law_id").select("law_id", F.concat(F.lit("本"), kind_of(clean_name(F.col("name")))).alias("alias"), "alias_law")


def citation_context(articles: DataFrame, laws: DataFrame) -> DataFrame:
    """Names that mean another law inside each law: law_id, alias, alias_law, source_law, kind (alias or basis).

    A law's own first article declares them; the volumes of one set of rules take over what
    本法 means in its general part, unless they say so themselves.
    """
    own = declared_aliases(articles, laws).withColumn("kind", F.lit("alias")).unionByName(declared_bases(articles, laws).withColumn("kind", F.lit("basis")))
    own = own.dropDuplicates(["law_id", "alias", "alias_law"]).withColumn("source_law", F.col("law_id"))
    volumes = laws.select("id", normalize("name").alias("name")).select("id", "name", F.regexp_extract("name", VOLUME, 1).alias("stem")).where("stem <> ''")
    general = volumes.where(F.endswith("name", F.lit(GENERAL_PART))).select("stem", F.col("id").alias("source_law"))
    given = own.where("alias = '本法'").select("source_law", "alias", "alias_law", "kind")
    taken = volumes.join(general, "stem").where("id <> source_law").select(F.col("id").alias("law_id"), "source_law").join(given, "source_law")
    taken = taken.join(own.where("alias = '本法'").select("law_id"), "law_id", "left_anti")
    return own.unionByName(taken).select("law_id", "alias", "alias_law", "source_law", "kind")


def unit_counts(units: DataFrame) -> DataFrame:
    """Per article the units it has: law_id, no, counts (for each paragraph the numbers of subitems of its items)."""
    subs = units.where("kind = 'subitem'").groupBy("law_id", "no", F.col("parent_id").alias("unit_id")).agg(F.count("*").cast("int").alias("n"))
    items = units.where("kind = 'item'").join(subs, ["law_id", "no", "unit_id"], "left").groupBy("law_id", "no", F.col("parent_id").alias("unit_id")).agg(F.array_sort(F.collect_list(F.struct("number", F.coalesce("n", F.lit(0)).alias("n")))).alias("items"))
    paragraphs = units.where("kind = 'paragraph'").join(items, ["law_id", "no", "unit_id"], "left")
    each = F.struct("number", F.coalesce(F.transform("items", lambda i: i["n"]), F.array().cast("array<int>")).alias("items"))
    return paragraphs.groupBy("law_id", "no").agg(F.transform(F.array_sort(F.collect_list(each)), lambda p: p["items"]).alias("counts"))


def resolved_units(found: DataFrame, articles: DataFrame, counts: DataFrame) -> DataFrame:
    """Citations (target_law, address, parts, ...) with one row for each unit they name: unit (empty: the article) and fallback.

    ``fallback`` marks parts that are named but can't be told for certain.
    """
    have = articles.select(F.col("law_id").alias("target_law"), "no", "address").join(counts.withColumnRenamed("law_id", "target_law"), ["target_law", "no"], "left").drop("no")
    rows = found.join(have, ["target_law", "address"], "left").withColumn("t", F.explode(unit_targets("parts", "counts")))
    unit = F.when(F.col("t.path") != "", F.concat("target_law", F.lit("/a:"), "address", F.lit("/"), "t.path")).otherwise("")
    return rows.withColumn("unit", unit).withColumn("fallback", F.col("t.fallback")).drop("t", "counts")


def article_units(articles: DataFrame) -> DataFrame:
    """Paragraphs, items and subitems: law_id, no, unit_id, parent_id, kind, number, start, end."""
    rows = articles.select("law_id", "no", "address", F.explode(units("text")).alias("u"))
    base = F.concat(F.col("law_id"), F.lit("/a:"), F.col("address"), F.lit("/"))
    parent = F.regexp_extract("u.path", "^(.*)/[^/]*$", 1)
    return rows.select("law_id", "no", F.concat(base, "u.path").alias("unit_id"), F.when(parent != "", F.concat(base, parent)).alias("parent_id"), "u.kind", "u.number", "u.start", "u.end")


def found_citations(texts: DataFrame, key: str, laws: DataFrame, articles: DataFrame) -> DataFrame:
    """Citations in ``texts(key, law_id, paragraph, text)`` resolved to existing articles.

    ``law_id`` (may be null) is the law that a text belongs to. A citation names its law
    just before it, in full or by a short name that the law's first article declares; 本X is the text's own law; 同X, 該X and 此X the last law of that kind
    named in the paragraph; after 至, 及, 、 and the like it is the law of the one before;
    without a name it is the only law named so far in the paragraph, or the text's own.
    A name that is no known law's leaves what follows without one. Ranges (至) give every
    existing article between, unless there are more than ``MOST``. Returned: key,
    paragraph, start, end, target_law, address, resolution, parts (as written). A name counts
    only where it begins (``at_boundary``).
    """
    c = texts.select(key, "law_id", "paragraph", F.posexplode(citations("text")).alias("at", "c")).select(key, "law_id", "paragraph", "at", "c.*")
    own = laws.select(F.col("id").alias("law_id"), F.col("kind").alias("own_kind"), normalize("name").alias("own_name"))
    c = c.join(own, "law_id", "left")
    # the register's names end the text before a citation: candidates are its suffixes
    every = c.select(key, "law_id", "paragraph", "at", "name", F.explode(tails(F.col("name"))).alias("tail"))
    every = every.where(at_boundary(F.left("name", F.length("name") - F.length("tail")))).drop("name")
    short = every.join(declared_aliases(articles, laws).withColumnRenamed("alias", "tail"), ["law_id", "tail"]).groupBy(key, "paragraph", "at").agg(F.max_by("alias_law", F.length("tail")).alias("alias_law"))
    ends = every.join(name_register(laws).withColumnRenamed("law_id", "named_law"), F.col("tail") == F.col("name"))
    named = ends.groupBy(key, "paragraph", "at").agg(F.max_by("named_law", F.length("tail")).alias("named_law"), F.max_by("tail", F.length("tail")).alias("tail"))
    c = c.join(named, [key, "paragraph", "at"], "left").join(short, [key, "paragraph", "at"], "left")
    token = F.regexp_extract("name", "([本同該此][^本同該此]{1,6})$", 1)
    self_ref = F.startswith(token, F.lit("本"))
    own_law = F.when(self_ref & owns(token, F.col("own_kind"), F.col("own_name")), F.col("law_id"))
    # groups of joined citations share the law of their first
    order = Window.partitionBy(key, "paragraph").orderBy("start")
    c = c.withColumn("group", F.sum(F.when(F.col("joined") == "", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    head = c.where("joined = ''").withColumn("token", token).withColumn("direct", F.coalesce("alias_law", "named_law", own_law))
    kinds = laws.select(F.col("id").alias("direct"), kind_of(clean_name(normalize("name"))).alias("direct_kind"))
    head = head.join(kinds, "direct", "left")
    before = Window.partitionBy(key, "paragraph").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # laws named before this place: the last of the kind that is asked for, and the only one if there is but one
    declared, asked = F.coalesce("alias_law", "named_law"), F.col("token").rlike("^[同該此]")
    place = [key, "paragraph"]
    head = scopes.in_force(head, place, ["start"], F.when(declared.isNotNull(), F.col("direct_kind")).otherwise(F.substr(F.col("token"), F.lit(2))), declared, F.lit(False), "last_law")
    head = scopes.only_one_so_far(head, place, ["start"], declared, "only_law")
    same = F.when(asked, F.col("last_law"))
    unknown = (F.col("name") != "") & F.col("direct").isNull() & same.isNull()
    poisoned = F.coalesce(F.max(unknown).over(before), F.lit(False))
    bare = F.when((F.col("name") == "") & ~poisoned, F.when(F.col("only_law_n") == 1, F.col("only_law")).when(F.col("only_law_n") == 0, F.col("law_id")))
    head = head.withColumn("target_law", F.coalesce("direct", same, bare)).withColumn(
        "resolution", F.when(F.col("alias_law").isNotNull(), "alias").when(F.col("named_law").isNotNull(), "named").when(F.col("direct").isNotNull(), "self").when(same.isNotNull() | (F.col("only_law_n") == 1), "paragraph").otherwise("source")
    )
    head = head.select(key, "paragraph", "group", "target_law", "resolution", F.col("unit").alias("head_unit"))
    rows = c.join(head, [key, "paragraph", "group"]).where(F.col("target_law").isNotNull() & (F.col("unit") == F.col("head_unit")))
    known = ordered_articles(articles).select(F.col("law_id").alias("target_law"), "address", "ordinal", F.right("no_norm", F.lit(1)).alias("unit"))
    rows = rows.join(known, ["target_law", "address", "unit"])
    inner = Window.partitionBy(key, "paragraph", "group").orderBy("start")
    rows = rows.withColumn("from", F.when(F.col("joined") == "至", F.lag("ordinal").over(inner))).withColumn("from_parts", F.lag("parts").over(inner))
    wide = (F.col("joined") == "至") & ((F.col("ordinal") < F.col("from")) | (F.col("ordinal") - F.col("from") > MOST) | (F.col("parts") != "") | (F.col("from_parts") != ""))
    rejected = F.max(F.coalesce(wide, F.lit(False))).over(Window.partitionBy(key, "paragraph", "group"))
    rows = rows.withColumn("rejected", rejected).where(~F.col("rejected"))
    each = rows.withColumn("ordinal", F.explode(F.when(F.col("from").isNotNull(), F.sequence(F.col("from") + 1, F.col("ordinal"))).otherwise(F.array("ordinal"))))
    return each.drop("address").join(known.select("target_law", "ordinal", "address"), ["target_law", "ordinal"]).select(key, "paragraph", "start", "end", "target_law", "address", "resolution", "parts")


def ordered_articles(articles: DataFrame) -> DataFrame:
    """``articles(law_id, address, ...)`` with their ordinal in the law, by (major, minor)."""
    part = lambda i: F.coalesce(F.split_part("address", F.lit("-"), F.lit(i)).try_cast("int"), F.lit(0))
    return articles.withColumn("ordinal", F.row_number().over(Window.partitionBy("law_id").orderBy(part(1), part(2))))


def law_definitions(articles: DataFrame, laws: DataFrame) -> DataFrame:
    """Terms that a law defines once, for itself: law_id, term, no, start, end."""
    rows = articles.select("law_id", "no", F.explode(definitions("text")).alias("d")).select("law_id", "no", "d.*")
    own = laws.select(F.col("id").alias("law_id"), "kind", F.regexp_replace("name", "（[^）]*）$", "").alias("name"))
    rows = rows.join(own, "law_id").where(owns(F.col("scope"), F.col("kind"), F.col("name")))
    once = rows.groupBy("law_id", "term").agg(F.count("*").alias("n")).where("n = 1")
    return rows.join(once, ["law_id", "term"], "left_semi").select("law_id", "term", "no", "start", "end")


def definition_uses(articles: DataFrame, defined: DataFrame, citations: DataFrame | None = None, most: int = 6) -> DataFrame:
    """First use of each defined term in each other article of its law, at most ``most`` terms an article.

    Places inside drawn tables, longer law names and ``citations(law_id, no, start, end)``
    don't count; the next place of the term does.
    """
    terms = articles.select("law_id", "no").join(defined.select("law_id", "term", F.col("no").alias("defined_in")), "law_id").where("no <> defined_in")
    own = terms.groupBy("law_id", "no").agg(F.collect_set("term").alias("terms"))  # terms of one law
    blocked = F.concat(F.filter(text_blocks("text"), lambda b: b["kind"] == "table").cast(SPAN_TYPE), F.transform(spans(F.col("text"), LAW_NAME), lambda x: F.struct(F.lit("name").alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
    rows = articles.select("law_id", "no", "text").join(own, ["law_id", "no"]).select("law_id", "no", blocked.alias("blocked"), term_spans("text", "terms").alias("uses"))
    if citations is not None:
        cited = citations.groupBy("law_id", "no").agg(F.collect_list(F.struct(F.lit("cited"), "start", "end")).cast(SPAN_TYPE).alias("cited"))  # of one article
        rows = rows.join(cited, ["law_id", "no"], "left").withColumn("blocked", F.concat("blocked", F.coalesce("cited", F.array().cast(SPAN_TYPE))))
    free = F.filter("uses", lambda u: ~F.exists("blocked", lambda b: (u["start"] < b["end"]) & (u["end"] > b["start"])))
    uses = rows.select("law_id", "no", F.explode(free).alias("u")).select("law_id", "no", F.col("u.text").alias("term"), "u.start", "u.end")
    first = uses.groupBy("law_id", "no", "term").agg(F.min("start").alias("start"), F.min("end").alias("end"))
    rank = Window.partitionBy("law_id", "no").orderBy("start")
    kept = first.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= most)
    return kept.join(terms, ["law_id", "no", "term"]).select("law_id", "no", "term", "defined_in", "start", "end")


def basis_relations(articles: DataFrame, laws: DataFrame) -> DataFrame:
    """(parent, child, no): a law whose first article says it is enacted under another's article."""
    first = articles.where("ord = 0").select(F.col("law_id").alias("child"), F.regexp_replace("text", "（以下簡稱本(?:法|條例)）", "").alias("text"))
    cited = first.select("child", F.regexp_extract("text", "(?:依據|依)(\\p{IsHan}+?)(第[0-9一二三四五六七八九十百零〇\\s]+條(?:之[0-9一二三四五六七八九十]+)?)", 1).alias("name"), F.regexp_extract("text", "(?:依據|依)(\\p{IsHan}+?)(第[0-9一二三四五六七八九十百零〇\\s]+條(?:之[0-9一二三四五六七八九十]+)?)", 2).alias("no"))
    names = laws.select(F.col("id").alias("parent"), "name")
    return cited.join(names, "name").where("parent <> child").select("parent", "child", "no")
