"""Chinese numerals and numbered addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits and units of Chinese numerals.
DIGITS = {"零": 0, "〇": 0, "○": 0, "Ｏ": 0, "一": 1, "二": 2, "兩": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
NUMERAL = "[0-9一二三四五六七八九十百千零〇兩]+"


def chinese_number(value: str) -> str:
    """A numeral as Arabic digits: by value if it has 十, 百 or 千, else digit by digit; unchanged if it is no numeral."""
    if re.fullmatch(r"[0-9]+", value):
        return value
    if not UNITS.keys() & set(value):
        return "".join(str(DIGITS.get(c, c)) for c in value)
    total = digit = 0
    for c in value:
        if c in UNITS:
            total, digit = total + (digit or 1) * UNITS[c], 0
        elif c in DIGITS:
            digit = DIGITS[c]
        else:
            return value
    return str(total + digit)


def cn_number(value: Column | str) -> Column:
    """``chinese_number`` of a column, folded over its characters."""
    v = F.col(value) if isinstance(value, str) else value
    digits, units = F.create_map(*[F.lit(x) for p in DIGITS.items() for x in p]), F.create_map(*[F.lit(x) for p in UNITS.items() for x in p])
    one_by_one = F.translate(v, "".join(DIGITS), "".join(map(str, DIGITS.values())))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("total"), zero.alias("digit"), F.lit(True).alias("ok"))

    def step(acc: Column, c: Column) -> Column:
        unit, digit = units[c], digits[c]
        many = F.when(acc["digit"] == 0, F.lit(1)).otherwise(acc["digit"])
        total = F.when(unit.isNotNull(), acc["total"] + many * unit).otherwise(acc["total"])
        last = F.when(unit.isNotNull(), zero).otherwise(F.coalesce(digit.cast("long"), acc["digit"]))
        return F.struct(total.cast("long").alias("total"), last.cast("long").alias("digit"), (acc["ok"] & (unit.isNotNull() | digit.isNotNull())).alias("ok"))

    by_value = F.aggregate(F.filter(F.split(v, ""), lambda c: c != ""), start, step, lambda acc: F.when(acc["ok"], (acc["total"] + acc["digit"]).cast("string")))
    return F.when(v.rlike(f"[{''.join(UNITS)}]"), F.coalesce(by_value, v)).otherwise(one_by_one)


def address(number: Column) -> Column:
    """``第77-1條`` -> ``77-1``."""
    return F.regexp_replace(number, "^第|[條點]$", "")


def address_order(addr: Column) -> Column:
    """(major, minor) of an address, by which inserted articles sort after the one they follow."""
    return F.struct(F.split_part(addr, F.lit("-"), F.lit(1)).try_cast("int").alias("major"), F.coalesce(F.split_part(addr, F.lit("-"), F.lit(2)).try_cast("int"), F.lit(0)).alias("minor"))
