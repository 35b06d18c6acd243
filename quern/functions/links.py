"""Addresses, metadata texts and small formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.numerals import address
from quern.functions.text import normalize

#: Pages of the official sites that have an address for each article, and what that looks like.
OFFICIAL = (
    ("law.moj.gov.tw", r"(?i)^/LawClass/Law(?:All|Single)\.aspx$", "pcode", "https://law.moj.gov.tw/LawClass/LawSingle.aspx?pcode="),
    ("web.law.ntpc.gov.tw", r"(?i)^/Scripts/FLAWDAT0202\.aspx$", "fcode", "https://web.law.ntpc.gov.tw/Scripts/FLAWDOC01.aspx?fcode="),
)
LAW_CODE = r"^[A-Z]\d{7}$"
#: Numerals in serial numbers and the digits they stand for.
WRITTEN, DIGITS = "零〇○一二三四五六七八九０１２３４５６７８９", "0001234567890123456789"


def part(url: Column, name: str, key: str | None = None) -> Column:
    return F.try_parse_url(url, F.lit(name), *([F.lit(key)] if key else []))


def article_address(no: Column) -> Column:
    """``第七十七條之一`` -> ``77-1``."""
    return address(normalize(no))


def unit_anchor(unit_id: Column) -> Column:
    """``X/a:3/p:1/i:2`` -> ``a-3-p-1-i-2``."""
    return F.translate(F.substr(unit_id, F.instr(unit_id, "/a:") + 1), "/:", "--")


def law_href(law: Column, article: Column, unit: Column, page: Column) -> Column:
    """Reading address of a law, with an anchor for a page, else a unit, else an article, where there is one."""
    anchor = F.when(page > 0, F.concat(F.lit("document-page-"), page.cast("string"))).when(F.coalesce(unit, F.lit("")) != "", unit_anchor(unit)).when(F.coalesce(article, F.lit("")) != "", F.concat(F.lit("a-"), article_address(article)))
    return F.concat(F.lit("/laws/"), F.replace(F.url_encode(law), F.lit("+"), F.lit("%20")), F.lit(".html"), F.coalesce(F.concat(F.lit("#"), anchor), F.lit("")))


def embed_url(base: Column, kind: Column, law: Column, article: Column, unit: Column, ruling: Column, expected: Column) -> Column:
    """Address of a quotation card for an article, unit or ruling; null for other kinds and addresses that are not http(s)."""
    field = lambda name, value: F.concat(F.lit(f"{name}="), F.url_encode(value))
    place = F.when((kind == "article") & law.isNotNull() & article.isNotNull(), F.concat_ws("&", field("law", law), field("article", article), F.when(unit.isNotNull(), field("unit", unit)))).when((kind == "ruling") & ruling.isNotNull(), field("ruling", ruling))
    return F.when(F.lower(part(base, "PROTOCOL")).isin("http", "https"), F.concat(F.regexp_extract(base, r"^(\w+://[^/?#]+)", 1), F.lit("/embed.html?"), place, F.lit("&expected="), expected))


def embed_selector(search: Column) -> Column:
    """Struct of what a card's address asks for (kind, law, article, unit, ruling, expected); null if it is not valid."""
    url = F.concat(F.lit("http://x/?"), search)
    value = lambda k: F.nullif(F.try_url_decode(part(url, "QUERY", k)), F.lit(""))
    law, article, unit, ruling = (value(k) for k in ("law", "article", "unit", "ruling"))
    expected = F.coalesce(value("expected"), F.lit(""))
    hashed = (expected == "") | expected.rlike("^[a-f0-9]{64}$")
    one = ruling.isNotNull() & law.isNull() & article.isNull() & unit.isNull() & ruling.rlike(r"^\d{1,10}$")
    named = ruling.isNull() & law.isNotNull() & article.isNotNull() & (F.length(law) <= 160) & ~law.rlike("[\\s/\\\\<>\"']") & (F.length(article) <= 80) & (F.coalesce(F.length(unit), F.lit(0)) <= 250)
    return F.when(hashed & (one | named), F.struct(F.when(one, "ruling").otherwise("article").alias("kind"), law.alias("law"), article.alias("article"), unit.alias("unit"), ruling.alias("ruling"), expected.alias("expected")))


def official_article(url: Column, no: Column) -> Column:
    """Struct (url, exact): the official page of one article where its site has such, else the law's page; null for unsafe addresses."""
    number = F.regexp_extract(normalize(no), r"^第(\d+(?:-\d+)?)條$", 1)
    exact = F.lit(None).cast("string")
    for host, path, key, page in OFFICIAL:
        code = F.coalesce(part(url, "QUERY", key), F.lit(""))
        here = (part(url, "HOST") == host) & part(url, "PATH").rlike(path) & code.rlike(LAW_CODE) & (number != "")
        exact = F.coalesce(exact, F.when(here, F.concat(F.lit(page), code, F.lit("&flno="), number)))
    safe = F.lower(part(url, "PROTOCOL")).isin("http", "https") & part(url, "USERINFO").isNull() & part(url, "HOST").isNotNull()
    return F.when(F.coalesce(safe, F.lit(False)), F.struct(F.coalesce(exact, url).alias("url"), exact.isNotNull().alias("exact")))


def law_description(region: Column, kind: Column, name: Column, coverage: Column, articles: Column, pages: Column, doc_format: Column, modified: Column) -> Column:
    """One line about a law for page metadata: place, kind, what is held of it, and when it was amended."""
    held = (
        F.when(doc_format == "html", "收錄官方正文與表格快照（未重新編號）")
        .when(doc_format.isNotNull(), F.concat(F.lit("收錄 "), pages.cast("string"), F.lit(" 頁官方圖文 PDF（未拆為項款）")))
        .when(coverage == "full", F.concat(F.lit("收錄 "), articles.cast("string"), F.lit(" 條原文快照")))
        .otherwise("官方來源索引，全文尚未收錄")
    )
    amended = F.when(F.coalesce(modified, F.lit("")) != "", F.concat(F.lit("來源修正日期："), modified, F.lit("。"))).otherwise("")
    return F.concat(region, F.lit("・"), kind, F.lit("。《"), name, F.lit("》"), held, F.lit("。"), amended, F.lit("查閱條文、相關函釋與官方來源。"))


def date_text(value: Column, otherwise: str = "未提供") -> Column:
    """The day of an ISO time, or what to show without one."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(otherwise)).otherwise(F.split_part(value, F.lit("T"), F.lit(1)))


def grouped_number(value: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(value, 0)


def serial_digits(text: Column) -> Column:
    """A serial number in Arabic digits: without 號 and white space."""
    return F.translate(F.regexp_replace(text, r"[號\s]", ""), WRITTEN, DIGITS)


def archive_status(versions: Column, only_hash: Column) -> Column:
    """What a law's archive holds, in words."""
    none = F.when(only_hash, "過往僅保留雜湊觀測，未保存可還原正文。").otherwise("尚未建立可還原的版本封存。")
    many = F.concat(F.lit("已保存 "), versions.cast("string"), F.lit(" 個完整版本。這是本庫觀測歷程，不代表官方全部歷史版本。"))
    return F.when(versions == 0, none).when(versions == 1, "已保存 1 個完整版本；封存基準之前的歷史正文尚未收錄。").otherwise(many)
