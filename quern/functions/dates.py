"""Dates in the Republic of China calendar and ISO form, mixed in one column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Year 1 of the calendar is 1912.
OFFSET = 1911
_ROC = r"(?:民國)?\s*(\d{1,3})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"


def roc_date(text: Column) -> Column:
    """``民國 113 年 3 月 1 日`` as a date; null if there is none or it is impossible."""
    part = [F.regexp_extract(text, _ROC, i).try_cast("int") for i in (1, 2, 3)]
    return F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", part[0] + OFFSET, part[1], part[2]), F.lit("yyyy-MM-dd")))


def compact_date(text: Column) -> Column:
    """``20240301`` -> ``2024-03-01``; anything else unchanged."""
    return F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")


def any_date(text: Column) -> Column:
    """ROC or ISO date; years from 9999 stand for no date."""
    iso = F.to_date(F.try_to_timestamp(F.left(compact_date(text), F.lit(10)), F.lit("yyyy-MM-dd")))
    return F.when(F.startswith(text, F.lit("9999")), None).otherwise(F.coalesce(roc_date(text), iso))


def taipei_date(utc: Column) -> Column:
    """Day in Taipei of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(utc, "Asia/Taipei"))
