"""Lines of text and pictures of a document merged into sections of blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.scans import Scan, scanned

#: Pictures that come this close belong together.
TOUCH = 2


def picture_groups(pictures: DataFrame, doc: str, *more: str) -> DataFrame:
    """Pictures (doc, page, top, bottom) numbered by group from 1 on their page: one that begins above the lowest end so far, or ``TOUCH`` below it, joins the group."""
    order = ["top", "bottom", *more]
    seen = scanned(pictures, [doc, "page"], order, quern_low=Scan("max", F.col("bottom"), before=True))
    fresh = F.when(F.col("quern_low").isNull() | (F.col("top") > F.col("quern_low") - TOUCH), 1).otherwise(0)
    return scanned(seen.withColumn("quern_fresh", fresh), [doc, "page"], order, group=Scan("sum", F.col("quern_fresh").cast("long"))).select(*pictures.columns, "group")


def merged(lines: DataFrame, pictures: DataFrame, doc: str, chapter: Column, section: Column, ends: Column, picture: str) -> DataFrame:
    """Blocks in reading order: doc, chapter, section, block (number in the document), at (of the first part), type, page (of the first part), last_page, text, pictures.

    ``lines``: doc, page, top, text; ``pictures``: doc, page, top, bottom and a column
    ``picture`` that tells them apart. A line that is a ``chapter`` or ``section`` heading
    begins one (a chapter ends the section) and is no block. Pictures of one group are one
    block. Other lines are added up to paragraphs: one ends with a line for which ``ends``
    is true, at a heading and at a picture, but not at the end of a page. chapter and
    section are numbers from 1 within the document and the chapter, 0 before the first.
    Parts at the same place: lines first.
    """
    groups = picture_groups(pictures, doc, picture).groupBy(doc, "page", "group").agg(F.min("top").alias("top"), F.array_sort(F.collect_list(F.struct("top", F.col(picture).alias("picture")))).alias("held"))  # of one page
    shown = groups.select(doc, "page", "top", F.lit(1).alias("side"), F.col("group").alias("nr"), F.transform("held", lambda h: h["picture"]).alias("pictures"))
    told = lines.select(doc, "page", "top", F.lit(0).alias("side"), F.lit(0).cast("long").alias("nr"), F.col("text"), chapter.alias("is_chapter"), section.alias("is_section"), ends.alias("ends"))
    both = told.unionByName(shown, allowMissingColumns=True).withColumn("is_head", F.coalesce(F.col("is_chapter") | F.col("is_section"), F.lit(False)))
    order = ["page", "top", "side", "nr"]
    one = lambda on: F.when(on, 1).otherwise(0).cast("long")
    # a block begins at a picture, and at a line after anything but an unfinished line
    state = F.struct((F.col("side") == 1).alias("picture"), F.col("is_head").alias("head"), F.coalesce("ends", F.lit(False)).alias("ends"))
    rows = scanned(both, [doc], order, chapter=Scan("sum", one(F.coalesce("is_chapter", F.lit(False)))), heads=Scan("sum", one(F.col("is_head"))), before=Scan("lag", state, before=True))
    opens = F.col("before").isNull() | F.col("before.picture") | F.col("before.head") | F.col("before.ends") | (F.col("side") == 1)
    rows = scanned(rows.where("not is_head or is_section").withColumn("opens", one(opens & ~F.col("is_head"))), [doc], order, block=Scan("sum", F.col("opens")))
    rows = scanned(rows, [doc, "chapter"], order, section=Scan("sum", one(F.coalesce("is_section", F.lit(False))))).where("not is_head")
    part = F.struct(*order, "text", "pictures")
    made = rows.groupBy(doc, "chapter", "section", "block").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # of one block
    first = F.get("parts", F.lit(0))
    return made.select(
        doc, "chapter", "section", "block", F.struct(first["page"].alias("page"), first["top"].alias("top"), first["side"].alias("side")).alias("at"),
        F.when(first["side"] == 1, "picture").otherwise("paragraph").alias("type"), first["page"].alias("page"), F.element_at("parts", -1)["page"].alias("last_page"),
        F.when(first["side"] == 0, F.array_join(F.transform("parts", lambda p: p["text"]), "")).alias("text"), first["pictures"].alias("pictures"),
    )


def nested(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a section: its blocks in order as an array of tagged structs."""
    block = F.struct("block", "type", "page", "last_page", "text", "pictures")
    return blocks.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(block)), lambda b: b.dropFields("block")).alias("blocks"))
