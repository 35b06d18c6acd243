"""Joins that the reference's lookups amount to."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names whose keys may go to every task at once.
FEW_NAMES = 1_000_000


def with_fallback(df: DataFrame, source: DataFrame, own: str, fallback: str, key: str, value: str) -> DataFrame:
    """``value`` of ``source`` by the row's own key, else by its fallback key."""
    first = source.select(F.col(key).alias(own), F.col(value).alias("quern_own"))
    second = source.select(F.col(key).alias(fallback), F.col(value).alias("quern_bulk"))
    return df.join(first, own, "left").join(second, fallback, "left").withColumn(value, F.coalesce("quern_own", "quern_bulk")).drop("quern_own", "quern_bulk")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def _runs(words: Column, n: int) -> Column:
    """Runs of ``n`` words; the whole if there are fewer."""
    return words if n == 1 else F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: F.array_join(F.slice(words, i, n), " "))


def _grams(text: Column, n: int) -> Column:
    """Substrings of ``n`` characters (a power of two), each zipped from two halves; one empty string for 0."""
    if not n:
        return F.array(F.lit(""))
    out, half = F.filter(F.split(text, ""), lambda c: c != ""), 1
    while half < n:

        def doubled(g: Column, half: int = half) -> Column:
            rest = F.greatest(F.size(g) - half, F.lit(0))
            return F.zip_with(F.slice(g, F.lit(1), rest), F.slice(g, F.lit(half + 1), rest), lambda a, b: F.concat(a, b))

        out, half = _once(out, doubled), 2 * half
    return out


def _name_keys(names: DataFrame, name: str, words: int) -> DataFrame:
    """Each name with the key that a text must hold to contain it, of its keys the one that the fewest names have.

    Inner words of a name stand between white space, so they are whole words of the text
    too; names without inner words are found by 8, 4, 2 or 1 of their characters.
    quern_kind: how many words (positive) or characters (negative) the key has.
    """
    n, size = F.size(F.split(name, r"\s+")) - 2, F.length(name)
    inner = F.slice(F.split(name, r"\s+"), F.lit(2), F.greatest(n, F.lit(0)))
    cases = [(n >= k, k, _runs(inner, k)) for k in range(words, 0, -1)] + [(size >= k, -k, _grams(F.col(name), k)) for k in (8, 4, 2, 1, 0)]
    kind, keys = F, F
    for on, k, made in cases:
        kind, keys = kind.when(on, F.lit(k)), keys.when(on, made)
    each = names.select(name).where(F.col(name).isNotNull()).distinct().select(name, kind.alias("quern_kind"), F.explode(F.array_distinct(keys)).alias("quern_key"))
    each = each.withColumn("quern_n", F.count("*").over(Window.partitionBy("quern_key")))
    least = F.min_by(F.struct("quern_kind", "quern_key"), F.struct("quern_n", "quern_key")).alias("quern_least")
    return each.groupBy(name).agg(least).select(name, "quern_least.*")


def token_matches(texts: DataFrame, text: str, names: DataFrame, name: str, words: int = 1) -> DataFrame:
    """Rows of ``texts`` with each name that occurs in the text, by an equi-join.

    Each name has one key that every text with it holds (at most ``words`` words, or some
    characters of a name too short for that); texts that hold the key are then searched.
    Keys of texts go with the text's hash, as texts are long; keys that no name has are
    dropped at once if the names are few (counted first).
    """
    heads = _name_keys(names, name, words)
    kinds = {r["quern_kind"]: r["count"] for r in heads.groupBy("quern_kind").count().collect()}
    n_words, n_chars = sorted(k for k in kinds if k > 0), sorted(-k for k in kinds if k <= 0)
    keys = [_once(F.split(text, r"\s+"), lambda ws: F.concat(*[_runs(ws, k) for k in n_words]))] if n_words else []
    keys += [_grams(F.col(text), k) for k in n_chars]
    every = F.array_distinct(F.concat(*keys)) if keys else F.array().cast("array<string>")
    wanted = heads.select("quern_key").distinct()
    held = texts.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("quern_text"), F.explode(every).alias("quern_key"))
    held = held.join(F.broadcast(wanted) if sum(kinds.values()) <= FEW_NAMES else wanted, "quern_key", "left_semi").distinct()
    pairs = held.join(heads.select(name, "quern_key"), "quern_key").join(names, name).drop("quern_key")
    found = texts.withColumn("quern_text", F.xxhash64(text)).join(pairs, "quern_text").where(F.contains(F.col(text), F.col(name)))
    return found.select(*texts.columns, *names.columns)


def equal_classes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose value others share: key, first (least key of its class), n (size of the class).

    Classes are counted by hash, so no long value is shuffled, then told apart by the value's digest.
    """
    hashed = rows.where(F.col(value).isNotNull()).select(key, F.sha2(value, 256).alias("quern_h"))
    classes = hashed.groupBy("quern_h").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
    return hashed.join(classes, "quern_h").select(key, "first", "n")


def vocabulary_hits(rows: DataFrame, key: str, text: str, names: DataFrame, word: str) -> DataFrame:
    """(key, word): words of ``names`` that a text holds as words of Latin letters, each once a text."""
    held = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)))).alias(word))
    return held.join(names.select(word).distinct(), word, "left_semi").select(key, word)


def referred_to(rows: DataFrame, refs: DataFrame, key: str, ref: str) -> DataFrame:
    """Rows that some reference points to."""
    return rows.join(refs.select(F.col(ref).alias(key)), key, "left_semi")


def specific_first(refs: DataFrame, group: Sequence[str], detail: str) -> DataFrame:
    """References without detail are dropped where the group has any with detail."""
    has = F.max(F.col(detail) != "").over(Window.partitionBy(*group))
    return refs.withColumn("quern_has", has).where((F.col(detail) != "") | ~F.col("quern_has")).drop("quern_has")


def unique_keys(df: DataFrame, key: str, identity: Sequence[str], row_id: str) -> DataFrame:
    """Each key that stands for one thing: its rows are alike in ``identity``; they resolve to the smallest id.

    Keys may be whole texts, so rows meet by digest; the key itself is read again for the rows that are left.
    """
    alike = F.sha2(F.to_json(F.struct(*identity), {"ignoreNullFields": "false"}), 256)
    digest = F.when(F.col(key).isNotNull(), F.sha2(F.col(key).cast("string"), 256))
    kinds = df.groupBy(digest.alias("quern_k")).agg(F.min(alike).alias("a"), F.max(alike).alias("b"), F.min(row_id).alias(row_id)).where("a = b").select("quern_k", row_id)
    own = df.select(key, row_id, digest.alias("quern_h")).join(kinds, row_id).where(F.col("quern_h").eqNullSafe(F.col("quern_k")))
    return own.dropDuplicates([row_id, "quern_h"]).select(key, row_id)


def contained_in(points: DataFrame, spans: DataFrame, key: Sequence[str], at: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Points with the span of the same key that holds them: start <= at < end."""
    left, right = points.alias("p"), spans.alias("s")
    same = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in key]
    on = (F.col(f"p.{at}") >= F.col(f"s.{start}")) & (F.col(f"p.{at}") < F.col(f"s.{end}"))
    for s in same:
        on = on & s
    return left.join(right, on, how).select("p.*", *[F.col(f"s.{c}") for c in spans.columns if c not in key])


def latest_before(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: Column) -> Column:
    """Last non-null ``value`` of the rows before this one."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(value, ignorenulls=True).over(w)


def as_of(left: DataFrame, right: DataFrame, key: Sequence[str], left_at: str, right_at: str, columns: Sequence[str]) -> DataFrame:
    """Each left row with the columns of the latest right row at or before it: one shuffle, no range join.

    Ties on the right go to the greatest ``columns``.
    """
    a = left.select("*", F.col(left_at).alias("quern_at"), F.lit(1).alias("quern_side"))
    b = right.select(*key, F.col(right_at).alias("quern_at"), F.struct(*columns).alias("quern_row"), F.lit(0).alias("quern_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("quern_at", "quern_side", F.col("quern_row")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("quern_row", F.last("quern_row", ignorenulls=True).over(w)).where("quern_side = 1")
    return seen.select(*left.columns, *[F.col(f"quern_row.{c}") for c in columns])


def expanded_ranges(ranges: DataFrame, members: DataFrame, key: str, start: str, end: str, ordinal: str, most: int = 20) -> DataFrame:
    """Existing members between two ordinals of a range; ranges longer than ``most`` steps are rejected."""
    r = ranges.where((F.col(end) >= F.col(start)) & (F.col(end) - F.col(start) <= most))
    each = r.withColumn(ordinal, F.explode(F.sequence(F.col(start), F.col(end))))
    return each.join(members, [key, ordinal])


def without_overlap(spans: DataFrame, blocked: DataFrame, key: Sequence[str], start: str, end: str) -> DataFrame:
    """Spans that overlap none of ``blocked`` (same key): one sort by key, no pairs.

    Of the blocked spans that begin before a span ends, the one that reaches farthest decides.
    A null key is in no other span's way.
    """
    a = spans.select("*", F.col(end).alias("quern_at"), F.lit(0).alias("quern_side"))
    b = blocked.select(*key, F.col(start).alias("quern_at"), F.col(end).alias("quern_reach"), F.lit(1).alias("quern_side"))
    w = Window.partitionBy(*key).orderBy("quern_at", "quern_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("quern_reach", F.max("quern_reach").over(w)).where("quern_side = 0")
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    return both.where(~known | F.col("quern_reach").isNull() | (F.col("quern_reach") <= F.col(start))).select(*spans.columns)


def greedy_disjoint(spans: Column) -> Column:
    """From an array of structs (start, end, ...) sorted by start: each that begins at or after the end of the last kept."""
    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.slice(spans, 1, 0).alias("kept"))
    step = lambda acc, s: F.when(s["start"] >= acc["end"], F.struct(s["end"].cast("bigint").alias("end"), F.concat(acc["kept"], F.array(s)).alias("kept"))).otherwise(acc)
    return F.aggregate(F.sort_array(spans), zero, step, lambda acc: acc["kept"])


def divided_by(have: DataFrame, need: DataFrame, group: str, item: str) -> DataFrame:
    """Groups of ``have`` that hold every item of ``need``."""
    n = need.select(item).distinct()
    total = n.agg(F.count("*").alias("total"))
    return have.join(n, item, "left_semi").groupBy(group).agg(F.count_distinct(item).alias("n")).join(total, F.col("n") == F.col("total")).select(group)


def next_at_or_after(points: DataFrame, anchors: DataFrame, key: Sequence[str], at: str, anchor: str) -> DataFrame:
    """Each point with the first anchor of its key at or after it, or null."""
    a = points.select("*", F.col(at).alias("quern_at"), F.lit(1).alias("quern_side"))
    b = anchors.select(*key, F.col(anchor).alias("quern_at"), F.col(anchor).alias("quern_anchor"), F.lit(0).alias("quern_side"))
    w = Window.partitionBy(*key).orderBy(F.desc("quern_at"), "quern_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("quern_anchor", F.last("quern_anchor", ignorenulls=True).over(w))
    return both.where("quern_side = 1").select(*points.columns, F.col("quern_anchor").alias(anchor))
