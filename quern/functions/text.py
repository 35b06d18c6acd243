"""Normalisation and other text functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.numerals import NUMERAL, chinese_number

#: Characters that lookups delete or treat alike.
ZERO_WIDTH = re.compile("[​-‍⁠﻿]")
DASHES = re.compile("[‐‑–—－]")
VARIANTS = str.maketrans({"台": "臺", "ㄧ": "一", "条": "條", "装": "裝", "号": "號"})
_WHOLE_ARTICLE = re.compile(f"^({NUMERAL})條$")
_SUB_POINT = re.compile(f"第({NUMERAL})之({NUMERAL})點")
_SUB_ARTICLE = re.compile(f"第({NUMERAL})(?:條之|之)({NUMERAL})條?")
_COUNTED = re.compile("第([一二三四五六七八九十百千零〇兩]+)([條項款點])")


def cleaned(text: str) -> str:
    """Compatibility forms composed, zero-width characters deleted."""
    return ZERO_WIDTH.sub("", unicodedata.normalize("NFKC", text))


def normalize_text(text: str) -> str:
    """The form in which texts and queries are compared; displayed texts are never changed."""
    s = DASHES.sub("-", cleaned(text).lower().translate(VARIANTS))
    s = re.sub(r"\s+", "", s)
    s = _WHOLE_ARTICLE.sub(r"第\1條", s)
    s = _SUB_POINT.sub(lambda m: f"第{chinese_number(m[1])}-{chinese_number(m[2])}點", s)
    s = _SUB_ARTICLE.sub(lambda m: f"第{chinese_number(m[1])}-{chinese_number(m[2])}條", s)
    return _COUNTED.sub(lambda m: f"第{chinese_number(m[1])}{m[2]}", s)


@F.pandas_udf(T.StringType())
def normalize(texts: pd.Series) -> pd.Series:
    """Spark has no NFKC, so whole batches go through Python."""
    return texts.map(normalize_text, na_action="ignore")


def squash(text: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(text, r"\s+", "")


def grams(text: Column) -> Column:
    """Distinct characters and pairs of neighbouring characters, in order of first sight."""

    def both(chars: Column) -> Column:
        # neighbours are zipped: substring() would walk the text from its start for each pair
        rest = F.greatest(F.size(chars) - 1, F.lit(0))
        return F.concat(chars, F.zip_with(F.slice(chars, F.lit(1), rest), F.slice(chars, F.lit(2), rest), lambda a, b: F.concat(a, b)))

    return F.array_distinct(F.transform(F.array(F.filter(F.split(text, ""), lambda c: c != "")), both)[0])


def occurrences(text: Column, phrase: Column | str) -> Column:
    """How often ``phrase`` occurs without overlaps; 0 for an empty phrase."""
    p = F.lit(phrase) if isinstance(phrase, str) else phrase
    gone = F.length(text) - F.length(F.replace(text, p, F.lit("")))
    return F.when(F.length(p) == 0, F.lit(0)).otherwise((gone / F.length(p)).cast("long")).cast("long")


def excerpt(text: Column, words: list[str], before: int = 25, size: int = 150) -> Column:
    """``size`` characters from a little before the first of ``words``, with ellipses where text was left out."""
    found = [F.nullif(F.instr(text, w), F.lit(0)) for w in words]
    first = F.coalesce(F.least(*found, F.lit(None).cast("int")) if found else F.lit(None), F.lit(1))
    start = F.greatest(F.lit(0), first - 1 - before)
    end = start + size
    return F.concat(F.when(start > 0, F.lit("…")).otherwise(F.lit("")), F.substr(text, start + 1, F.lit(size)), F.when(F.length(text) > end, F.lit("…")).otherwise(F.lit("")))


def preview(body: Column, size: int = 220) -> Column:
    """Start of a ruling without its label and subject line, white space run together."""
    bare = F.regexp_replace(F.trim(body), "^(?:主旨|說明|要旨)[:：]\\s*", "")
    flat = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.left(flat, F.lit(size)), F.lit("…"))).otherwise(flat)


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def redact_logs(text: Column) -> Column:
    """Credentials in log lines replaced by ***."""
    text = F.regexp_replace(text, r"(?i)(https?://)[^\s/@]+@", "$1***@")
    text = F.regexp_replace(text, r"(?i)(authorization:\s*(?:bearer|basic|token)\s+)\S+", "$1***")
    return F.regexp_replace(text, r"(?i)((?:token|password|secret|api_?key)\s*[=:]\s*)\S+", "$1***")


def highlighted(text: Column, words: list[str], left: str = "<mark>", right: str = "</mark>") -> Column:
    """Marks each of ``words``, longest first where they overlap."""
    if not words:
        return text
    pattern = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    return F.regexp_replace(text, f"({pattern})", f"{left}$1{right}")


def fnv1a(text: str) -> int:
    h = 0x811C9DC5
    for unit in memoryview(text.encode("utf-16-le")).cast("H"):
        h = ((h ^ unit) * 0x01000193) & 0xFFFFFFFF
    return h


def fnv1a_hash(text: Column) -> Column:
    """``fnv1a`` of a column: folded over its UTF-16 units, two for a character beyond the first 65,536."""
    prime, bits = F.lit(0x01000193), F.lit(0xFFFFFFFF)
    eat = lambda h, unit: (h.bitwiseXOR(unit) * prime).bitwiseAND(bits)

    def step(h: Column, code: Column) -> Column:
        over = code - 0x10000
        pair = eat(eat(h, F.shiftright(over, 10) + 0xD800), over.bitwiseAND(F.lit(0x3FF).cast("long")) + 0xDC00)
        return F.when(over < 0, eat(h, code)).otherwise(pair)

    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), step)


def hash_fraction(text: Column | str) -> Column:
    """A number in [0, 1) that depends on the text alone."""
    return fnv1a_hash(F.col(text) if isinstance(text, str) else text) / 2.0**32


def fingerprint(*named: Column) -> Column:
    """SHA-256 of the given columns as JSON in the order of their names; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256)


def cell_width(text: Column) -> Column:
    """Columns that a text takes where Han, kana and full-width characters take two."""
    wide = F.length(F.regexp_replace(text, r"[^ᄀ-ᅟ⺀-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦]", ""))
    return (F.length(text) + wide).cast("long")
