"""Ordered rules that give a text one label: the first pattern that matches wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name endings that tell a law's kind, longest first, and its broader category.
KINDS = ("自治條例", "自治規則", "條例", "規則", "辦法", "細則", "準則", "要點", "基準", "注意事項", "標準", "通則", "規程", "規範", "編", "法")
NAMED_ENDINGS = ("法", "條例", "辦法", "規則", "編")
REPEALED = "停止適用|不再援引|不再適用|廢止"


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """Label of the first (pattern, label) whose pattern is found in ``text``."""
    out = F.lit(otherwise)
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def kind_of(name: Column) -> Column:
    """Ending of a law's name that tells its kind, or empty."""
    return F.regexp_extract(name, f"({'|'.join(KINDS)})$", 1)


def clean_name(name: Column) -> Column:
    """A normalised name without the date of enactment in brackets at its end."""
    return F.regexp_replace(name, r"\([0-9.年月日]+(?:訂定|修正)\)$", "")


def mentions_repeal(text: Column) -> Column:
    return F.when(text.rlike(REPEALED), F.lit("mentioned")).otherwise(F.lit("unchecked"))


def coverage_class(coverage: Column, has_document: Column) -> Column:
    """full, document or link."""
    return F.when(coverage == "full", F.lit("full")).when(has_document, F.lit("document")).otherwise(F.lit("link"))
