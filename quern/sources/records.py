"""Readers for law archives: XML, HTML, JSON feeds, page texts."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.windows import heading_stack

#: The feed's element names; it misspells that of an article's text, other copies of it don't.
LAW_XML = (
    "LawLevel string, LawName string, LawURL string, LawCategory string, LawModifiedDate string, LawEffectiveDate string, LawAbandonNote string, LawForeword string, "
    "LawArticles struct<Article: array<struct<ArticleType string, ArticleNo string, ArticleConctent string, ArticleContent string>>>, "
    "LawAttachements struct<File: array<struct<FileName string, FileURL string>>>, _corrupt_record string"
)


def xml_laws(spark: SparkSession, path: str, row_tag: str = "Law", schema: str = LAW_XML) -> tuple[DataFrame, DataFrame]:
    """(good records, records that can't be parsed): a bad record never stops the scan."""
    rows = spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").schema(schema).load(path)
    bad = F.col("_corrupt_record").isNotNull() | F.col("LawName").isNull()
    return rows.where(~bad).drop("_corrupt_record"), rows.where(bad).select("_corrupt_record")


def xml_articles(laws: DataFrame, key: str = "LawName") -> DataFrame:
    """Articles and headings in order: key, ord, type, no, text."""
    return laws.select(key, F.posexplode("LawArticles.Article").alias("ord", "a")).select(key, "ord", F.col("a.ArticleType").alias("type"), F.col("a.ArticleNo").alias("no"), F.coalesce("a.ArticleConctent", "a.ArticleContent").alias("text"))


#: Types of elements between articles, and the levels of headings, highest first.
HEADING_TYPE, ARTICLE_TYPE, LEVELS = "C", "A", "編章節款目"


def xml_law_texts(laws: DataFrame, key: str = "LawName") -> DataFrame:
    """Articles with the headings above them: key, ord, no, text, path."""
    rows = xml_articles(laws, key)
    label = F.trim(F.regexp_replace("text", r"\s+", " "))
    mark = F.regexp_extract(label, f"([{LEVELS}])", 1)
    level = F.when(F.col("type") == HEADING_TYPE, F.when(mark == "", 2).otherwise(F.instr(F.lit(LEVELS), mark)))
    stacked = heading_stack(rows.select("*", level.alias("level"), label.alias("label")), [key], ["ord"], "level", "label", len(LEVELS))
    path = F.array_compact(F.array(*[F.col(f"h{k}") for k in range(1, len(LEVELS) + 1)]))
    return stacked.where(F.col("type") == ARTICLE_TYPE).select(key, "ord", F.trim(F.regexp_replace("no", r"\s+", " ")).alias("no"), F.trim("text").alias("text"), path.alias("path"))


def xml_attachments(laws: DataFrame, key: str = "LawName") -> DataFrame:
    """Files that come with a law: key, title, url."""
    return laws.select(key, F.explode("LawAttachements.File").alias("f")).select(key, F.coalesce(F.nullif("f.FileName", F.lit("")), F.lit("附件")).alias("title"), F.col("f.FileURL").alias("url"))


def current_laws(laws: DataFrame, wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Laws of the feed to take in: in force, with a code in their address, named in ``wanted(name)``, not in ``present(id)``; code is added."""
    rows = laws.withColumn("code", F.coalesce(F.try_parse_url("LawURL", F.lit("QUERY"), F.lit("pcode")), F.lit("")))
    rows = rows.where((F.coalesce(F.trim("LawAbandonNote"), F.lit("")) == "") & (F.col("code") != ""))
    return rows.join(wanted.select(F.col("name").alias("LawName")), "LawName", "left_semi").join(present.select(F.col("id").alias("code")), "code", "left_anti")


def verified_shards(spark: SparkSession, folder: str, manifest: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(file, data) of JSON files whose SHA-256 is the one in ``manifest(file, sha256)``, and (file, reason) of what is missing or different."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    both = manifest.select("file", "sha256").join(files, "file", "left").withColumn("same", F.sha2("content", 256) == F.col("sha256"))
    good = both.where("same").select("file", F.from_json(F.col("content").cast("string"), schema, {"mode": "FAILFAST"}).alias("data"))
    return good, both.where("not coalesce(same, false)").select("file", F.when(F.col("content").isNull(), "missing").otherwise("different").alias("reason"))


def page_range(pages: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """The texts of pages first..last of each key as one: key, text. ``pages``: key, page, text, first, last."""
    inside = pages.where(F.col("page").between(F.col(first), F.col(last)))
    return inside.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("text"))


def guarded(items: DataFrame, sources: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """Items whose source is known and has the digest they were made from; and the others with the reason."""
    now = sources.select(key, F.col(digest).alias("quern_now"), F.lit(True).alias("quern_known"))
    reason = F.when(F.col("quern_known").isNull(), "unknown-source").when(~F.col(digest).eqNullSafe(F.col("quern_now")), "source-changed")
    rows = items.join(now, key, "left").withColumn("reason", reason).drop("quern_now", "quern_known")
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def zip_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Members of ZIP archives: path, member, content, sha256. One archive is held by one task at a time."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith(suffix):
                            yield pd.DataFrame({"path": [archive], "member": [name], "content": [z.read(name)]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unpack, "path string, member string, content binary").withColumn("sha256", F.sha2("content", 256))


def verified(files: DataFrame, expected: DataFrame, key: str = "path") -> DataFrame:
    """Files whose SHA-256 is the expected one (key, sha256)."""
    return files.withColumn("quern_sha", F.sha2("content", 256)).join(expected.select(key, F.col("sha256").alias("quern_sha")), [key, "quern_sha"], "left_semi").drop("quern_sha")


class Text(HTMLParser):
    """Visible text of a page: blocks on lines of their own; scripts, styles and comments left out."""

    BLOCKS = frozenset("p div br li ul ol tr table section article header footer h1 h2 h3 h4 h5 h6 pre blockquote title dt dd".split())
    HIDDEN = frozenset("script style template noscript".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in self.HIDDEN
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def page_text(html: str) -> str:
    reader = Text()
    reader.feed(html)
    reader.close()
    lines = (re.sub(r"[ \t\r\f\v\xa0]+", " ", line).strip() for line in "".join(reader.parts).split("\n"))
    return "\n".join(line for line in lines if line)


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(page_text, na_action="ignore")


class Cells(HTMLParser):
    """Rows of all tables as lists of cell texts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.cell = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = True
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("")
        elif tag == "br" and self.cell:
            self.rows[-1][-1] += "\n"

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr"):
            self.cell = False

    def handle_data(self, data: str) -> None:
        if self.cell:
            self.rows[-1][-1] += data


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def table_rows(html: pd.Series) -> pd.Series:
    """Cells of every table row."""

    def one(h: str | None) -> list[list[str]]:
        reader = Cells()
        reader.feed(h or "")
        reader.close()
        return [[re.sub(r"[ \t\xa0]+", " ", c).strip() for c in r] for r in reader.rows if r]

    return html.map(one)


def html_articles(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Articles in two-column tables (number, text): key, ord, no, text."""
    rows = pages.select(key, F.posexplode(table_rows(html)).alias("ord", "r")).where((F.size("r") >= 2) & F.col("r")[0].rlike(r"^第\s*[0-9一二三四五六七八九十百零〇]+\s*[條點]"))
    return rows.select(key, "ord", F.regexp_replace(F.col("r")[0], r"\s", "").alias("no"), F.col("r")[1].alias("text"))


def pages_of(text: Column) -> Column:
    """Pages of a text in which form feeds end them."""
    return F.split(F.regexp_replace(text, "\f$", ""), "\f")


def page_rows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(pages_of(F.col(text))).alias("at", "text")).select(key, (F.col("at") + 1).alias("page"), "text")


def html_attribute(html: str, tag: str, attribute: str) -> Column:
    """Value of an attribute of the first such tag, in double quotes and beginning with the letters of it; empty if there is none."""
    return F.regexp_extract(html, f'<{tag}\\s[^>]*?{attribute}="([A-Za-z]+)"', 1)


def json_field(json: str, name: str, kind: str) -> Column:
    """A declared field of a JSON object column."""
    return F.from_json(json, f"{name} {kind}").getField(name)


def json_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of records with declared columns; any that doesn't fit fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


ENTRY = "array<struct<id: string, title: string, quote: string, contentHash: string, note: string>>"
CASEBOOK = f"struct<schemaVersion: int, folders: array<struct<id: string, name: string, entries: {ENTRY}>>>"


def casebook_entries(raw: DataFrame, column: str = "json") -> DataFrame:
    """Entries of saved casebooks whose quote still has its hash: folder_id, folder, ord and the entry's columns."""
    book = raw.select(F.from_json(column, CASEBOOK, {"mode": "FAILFAST"}).alias("b"))
    folders = book.select(F.explode("b.folders").alias("f"))
    entries = folders.select(F.col("f.id").alias("folder_id"), F.col("f.name").alias("folder"), F.posexplode("f.entries").alias("ord", "e")).select("folder_id", "folder", "ord", "e.*")
    return entries.where(F.sha2("quote", 256) == F.col("contentHash"))


WATCHED = "map<string, struct<title: string, quote: string, contentHash: string, sourceHash: string, observedAt: string>>"


def watch_store(raw: DataFrame, column: str = "json") -> DataFrame:
    """Watched items of stored JSON objects: key and its snapshot."""
    return raw.select(F.explode(F.from_json(column, WATCHED, {"mode": "FAILFAST"})).alias("key", "w")).select("key", "w.*")


def routes(urls: DataFrame, url: str = "url") -> DataFrame:
    """Parts of reading addresses: law, article, unit, ruling and query, empty where absent."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.col(url))
    part = lambda p: F.regexp_extract(path, p, 1)
    anchor = F.coalesce(F.try_parse_url(url, F.lit("REF")), F.lit(""))
    return urls.select("*", part(r"/laws?/([^/#?]+)").alias("law"), part(r"/rulings?/(\d+)").alias("ruling"), F.regexp_extract(anchor, r"^a-(\d+(?:-\d+)?)", 1).alias("article"), F.regexp_extract(anchor, r"^a-\d+(?:-\d+)?((?:-[pis]\d+)+)$", 1).alias("unit"), F.coalesce(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("q"))), F.lit("")).alias("query"))


def file_states(df: DataFrame) -> str:
    """A digest of the paths, sizes and times of the files that a table reads: another one when any has changed."""
    spark = df.sparkSession
    conf, digest = spark._jsc.hadoopConfiguration(), hashlib.sha256()
    for file in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(conf).getFileStatus(path)
        digest.update(f"{file}\n{status.getLen()}\n{status.getModificationTime()}\n".encode())
    return digest.hexdigest()
