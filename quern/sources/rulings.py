"""Rulings of a public feed: records with HTML letters become rows, references and links."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.chains import first_match, mentions_repeal
from quern.functions.dates import OFFSET, taipei_date
from quern.functions.numerals import NUMERAL, chinese_number
from quern.functions.text import normalize
from quern.operators.evidence import serial_links, serial_numbers
from quern.operators.joins import specific_first, token_matches, unique_keys

#: How a letter's first line names its sender and number; topics by words of the title or the unit, the first that fits.
HEADER = "^(?:(?:內政部|行政院|營建署|國土管理署|本部|台灣省|臺灣省|經濟部|法務部|財政部|教育部|交通部|省政府)[^\\n]{0,180}?號(?:書函|代電|函|令|公告)?)"
DEFAULT_UNIT, DEFAULT_TOPIC = "國土管理署", "建築設計與管理"
TOPICS = (
    ("title", "公寓大廈|區分所有權人|管理委員", "公寓大廈"),
    ("title", "室內裝修|使用類組|變更使用|公共安全檢查", "使用與室內裝修"),
    ("title", "農舍|農業設施|農業用地", "農舍與農業設施"),
    ("title", "都市更新|危險及老舊|危老", "都更與危老"),
    ("unit", "更新", "都更與危老"),
    ("unit", "下水道", "下水道與設備"),
    ("title", "下水道|排水設備", "下水道與設備"),
    ("unit", "住宅發展", "住宅政策"),
    ("unit", "都市計畫|國土計畫|都市基礎", "都市計畫與土地"),
)
CATEGORIES = (
    ("都市更新|危險及老舊|危老", "都市更新與危老"), ("消防|防火|容留人數", "消防與公共安全"), ("農業|農舍|水土保持|山坡地", "農業與山坡地"),
    ("都市計畫|畸零地|都市設計|土地", "都市計畫與土地"), ("廣告|使用|室內|容留", "使用與室內裝修"),
)
DEFAULT_CATEGORY = "建築與設計"
#: Written article numbers, what joins them, what makes a name part of a longer word, names that a letter may declare.
ARTICLE = rf"第({NUMERAL})(?:條之|之)({NUMERAL})條?|第({NUMERAL})(?:-({NUMERAL}))?條"
JOINED, CLOSING, LONGER, DECLARED = "[、及與或，,]+", "」』）)", "令規", "[」』]?[(（]以下簡稱(本法|本條例|本辦法|本規則|本標準)[)）]"
#: A number of at least so many digits tells one letter from others.
LEAST_DIGITS = 7

LETTER = T.StructType([T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "url")])))])


class Letter(HTMLParser):
    """Text of a letter, lines and cells kept apart, and what it links to or shows."""

    BREAKS = {"p": "\n", "div": "\n", "tr": "\n", "li": "\n", "h1": "\n", "h2": "\n", "h3": "\n", "table": "\n", "td": "\t", "th": "\t"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.open: tuple[str, int] | None = None
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        self.hidden += tag in ("script", "style")
        if tag == "br":
            self.parts.append("\n")
        elif tag == "a" and given.get("href"):
            self.open = (given["href"].strip(), len(self.parts))
        elif tag == "img" and given.get("src"):
            self.links.append((given.get("alt") or "", given["src"].strip()))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag == "a" and self.open:
            self.links.append(("".join(self.parts[self.open[1] :]).strip(), self.open[0]))
            self.open = None
        self.parts.append(self.BREAKS.get(tag, ""))

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


@F.pandas_udf(LETTER)
def letters(content: pd.Series) -> pd.DataFrame:
    """Text and links of each letter; line ends written out as \\r\\n or \\n count as such."""

    def one(html: str | None) -> tuple[str, list]:
        reader = Letter()
        reader.feed((html or "").replace("\\r\\n", "\n").replace("\\n", "\n"))
        reader.close()
        lines = (re.sub(r"[ \t]+", " ", x).strip() for x in "".join(reader.parts).replace("\xa0", " ").splitlines())
        return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip(), reader.links

    return pd.DataFrame([one(h) for h in content], columns=["text", "links"])


#: Digits and signs of dates in full width, and what they stand for.
FULL_WIDTH, HALF_WIDTH = "０１２３４５６７８９．／", "0123456789./"


def issued(header: Column) -> Column:
    """ISO day of a date in the Republic of China calendar that a header gives (84.3.5, 84/3/5, 84年3月5日, in full-width signs too); empty if none or impossible."""
    plain = F.translate(header, FULL_WIDTH, HALF_WIDTH)
    part = [F.regexp_extract(plain, r"(?<!\d)(\d{2,3})[.年/](\d{1,2})[.月/](\d{1,2})(?!\d)", i).try_cast("int") for i in (1, 2, 3)]
    day = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", part[0] + OFFSET, part[1], part[2]), F.lit("yyyy-MM-dd"))
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))


def published(value: Column) -> Column:
    """Day in Taipei of an ISO time; empty if there is none."""
    return F.coalesce(F.date_format(taipei_date(F.try_to_timestamp(value)), "yyyy-MM-dd"), F.lit(""))


def article_key(text: str, at: int = 0) -> tuple[str, int] | None:
    """Normal form of the article number that begins at ``at``, and where it ends."""
    m = re.compile(ARTICLE).match(text, at)
    if not m:
        return None
    major, minor = (m[1], m[2]) if m[1] else (m[3], m[4])
    return f"第{chinese_number(major)}{f'-{chinese_number(minor)}' if minor else ''}條", m.end()


def topic(title: Column, unit: Column) -> Column:
    """Topic of a letter by its title or unit."""
    out = F.lit(DEFAULT_TOPIC)
    for field, pattern, label in reversed(TOPICS):
        out = F.when({"title": title, "unit": unit}[field].rlike(pattern), F.lit(label)).otherwise(out)
    return out


def category(name: Column) -> Column:
    """Category of a local law by its name."""
    return first_match(name, list(CATEGORIES), DEFAULT_CATEGORY)


def ruling_rows(raw: DataFrame) -> DataFrame:
    """Letters of the feed as rows: id, title, number, number_key, date, published, body, unit, topic, status, links.

    ``raw``: id, title, content, unit, publish_up. Letters without any text are left out.
    """
    read = raw.withColumn("letter", letters("content")).where(F.col("letter.text") != "")
    first = F.split_part("letter.text", F.lit("\n"), F.lit(1))
    rows = read.withColumn("number", F.regexp_extract(first, HEADER, 0)).withColumn("unit", F.coalesce(F.nullif("unit", F.lit("")), F.lit(DEFAULT_UNIT)))
    body = F.trim(F.when(F.col("number") != "", F.substr("letter.text", F.length("number") + 1)).otherwise(F.col("letter.text")))
    rows = rows.withColumn("title", F.trim("title")).withColumn("body", F.regexp_replace(body, r"^\s+|\s+$", ""))
    numbers = serial_numbers(F.col("number"))
    return rows.select(
        "id", "title", "number", F.coalesce(F.get(numbers, F.size(numbers) - 1), F.lit("")).alias("number_key"), issued(F.col("number")).alias("date"), published(F.col("publish_up")).alias("published"),
        "body", "unit", topic(F.col("title"), F.col("unit")).alias("topic"), mentions_repeal(F.concat_ws("\n", "title", "body")).alias("status"), F.col("letter.links").alias("links"),
    )


MENTIONS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "article", "evidence")]))


def mentioned(text: str, names: list[str]) -> list[tuple[str, str, str]]:
    """(name, article or empty, words) of every law that a normalised text names, with the articles right after it or after a short name that it declares."""
    if not names:
        return []
    pattern, out, short = re.compile("|".join(map(re.escape, sorted(names, key=lambda n: (-len(n), n))))), [], {}
    for m in pattern.finditer(text):
        if m[0].endswith("法") and text[m.end() : m.end() + 1] in tuple(LONGER):
            continue
        out.append((m[0], "", m[0]))
        at = m.end()
        while at < len(text) and text[at] in CLOSING:
            at += 1
        while found := article_key(text, at):
            out.append((m[0], found[0], m[0] + text[at : found[1]]))
            gap = re.compile(JOINED).match(text, found[1])
            at = gap.end() if gap else len(text)
        if declared := re.compile(DECLARED).match(text, m.end()):
            short[declared[1]] = (m[0], declared[0])
    for alias, (name, words) in short.items():
        for m in re.finditer(re.escape(alias), text):
            if found := article_key(text, m.end()):
                out.append((name, found[0], f"{text[m.start() : found[1]]}；{name}{words}"))
    return list(dict.fromkeys(out))


@F.pandas_udf(MENTIONS)
def mentions(texts: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([mentioned(t, list(n)) for t, n in zip(texts, names, strict=True)], dtype=object)


def ruling_refs(rulings: DataFrame, names: DataFrame, articles: DataFrame) -> DataFrame:
    """References of rulings: ruling, law, article (null for the law as a whole), evidence.

    ``names(name, law)`` in normal form; ``articles(law, no, key)``. Only articles that exist
    count; a law as a whole only where the ruling names none of its articles.
    """
    texts = rulings.select(F.col("id").alias("ruling"), normalize(F.concat_ws("\n", "title", "body")).alias("quern_body"))
    held = token_matches(texts, "quern_body", names.select("name"), "name", words=1).groupBy("ruling").agg(F.collect_set("name").alias("names"))  # at most the register of names
    found = texts.join(held, "ruling").select("ruling", F.explode(mentions("quern_body", "names")).alias("m")).select("ruling", "m.*")
    lawful = found.join(names, "name").join(articles.select("law", F.col("key").alias("article"), "no"), ["law", "article"], "left").where("article = '' or no is not null")
    first = lawful.groupBy("ruling", "law", F.coalesce("no", F.lit("")).alias("no")).agg(F.min("evidence").alias("evidence"))
    return specific_first(first, ["ruling", "law"], "no").select("ruling", "law", F.nullif("no", F.lit("")).alias("article"), "evidence")


def ruling_links(rulings: DataFrame) -> DataFrame:
    """(key, id): letters whose number another letter's text gives; letters filed twice count as the one with the least id."""
    numbered = rulings.where(F.length("number_key") >= LEAST_DIGITS).select("number_key", F.col("id").cast("long").alias("id"), normalize("number").alias("n"), normalize("body").alias("b"))
    return serial_links(rulings.select(F.col("id").cast("long").alias("key"), "body"), "key", "body", unique_keys(numbered, "number_key", ["n", "b"], "id"))
