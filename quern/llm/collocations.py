"""Phrase collocations: all runs of one to a few words counted by language, scored by their cuts.

Runs of words are exploded into rows (language, phrase, count) in slices of the texts,
counted there, then added up by Spark. A phrase can only be as frequent as the words and
shorter phrases in it, so words are counted first, then pairs of words that may be
frequent, then longer runs of such pairs. "May be" is asked of a bitmap of fixed size that
has the hash of every frequent phrase: a wrong yes costs a row that the exact count drops,
and there is no wrong no, so nothing frequent is lost.

The counts of a phrase's two parts come by joins on the parts; parts of a frequent phrase
are frequent, so every part is there. Scores are decimals. A phrase inside a longer one is
always inside one of one word more that is as frequent as that or more, so dropping asks
for extensions by one word alone.

Null texts are empty; null languages are ``und``. Repeated rows count each. Texts of any
length are read whole (slices are cut between texts). Other columns are left out, whatever
their names. An empty table, or one without frequent phrases, gives no rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.memory import lean
from quern.llm.store import finished, pick, written

#: Bits of a bitmap of frequent phrases; 32,768 of them are one row when it is made.
BITS, CHUNK = 1 << 26, 1 << 15
#: Bytes of text that are cut into words at once.
SLICE_BYTES = 2 << 20
#: Marks the ends of pieces; no byte of UTF-8.
END = b"\xff"
#: Lower-cases A to Z, ends pieces at fixed signs, turns tabs into spaces.
BYTES = bytes(c + 32 if 65 <= c <= 90 else 255 if chr(c) in ".,;:!?\n\v\f\r" else 32 if c == 9 else c for c in range(256))

COUNTED = "lang string, n int, phrase string, a bigint"


def slices(texts: pa.Array, langs: pa.Array) -> Iterator[tuple[str, bytes]]:
    """Texts of one language joined up to ``SLICE_BYTES`` (one text at least)."""
    for lang in pc.unique(langs).to_pylist():
        held, size = [], 0
        for text in texts.filter(pc.equal(langs, lang)).cast(pa.binary()):
            held.append(text.as_py())
            size += len(held[-1])
            if size >= SLICE_BYTES:
                yield lang, END.join(held)
                held, size = [], 0
        if held:
            yield lang, END.join(held)


def tokens(data: bytes) -> tuple[list[bytes], np.ndarray]:
    """The distinct words, and the number of each word in order; 0 stands between pieces."""
    number = defaultdict(itertools.count().__next__)
    number[END]  # 0
    found = data.translate(BYTES).replace(END, b" \xff ").split()
    ids = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
    return list(number), ids


def maybe(phrases: list[bytes], lang: str, bitmap: np.ndarray) -> np.ndarray:
    """Of each phrase whether it may be frequent."""
    head = zlib.crc32(lang.encode() + b" ")
    bits = np.fromiter((zlib.crc32(p, head) for p in phrases), np.int64, len(phrases)) % BITS
    return (bitmap[bits >> 3] >> (bits & 7)) & 1 == 1


def counted_runs(data: bytes, lang: str, lengths: list[int], words_bitmap: np.ndarray | None, pairs_bitmap: np.ndarray | None) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(n, phrases, counts) of a slice for each wanted length; n = 0 has the number of all words."""
    vocabulary, ids = tokens(data)
    names = pa.array(vocabulary, pa.large_binary())
    if lengths == [1]:
        counts = np.bincount(ids, minlength=len(vocabulary))
        yield 1, names[1:], counts[1:]
        yield 0, pa.array([b""], pa.large_binary()), counts[1:].sum(keepdims=True)
        return
    known = maybe(vocabulary, lang, words_bitmap)
    known[0] = False
    good = known[ids]
    at = np.flatnonzero(good[:-1] & good[1:])  # where pairs begin
    keys, place, counts = np.unique(ids[at] * len(vocabulary) + ids[at + 1], return_inverse=True, return_counts=True)
    space = pa.scalar(b" ", pa.large_binary())
    phrases = pc.binary_join_element_wise(names.take(pa.array(keys // len(vocabulary))), names.take(pa.array(keys % len(vocabulary))), space)
    if lengths == [2]:
        yield 2, phrases, counts
        return
    frequent = maybe(phrases.to_pylist(), lang, pairs_bitmap)[place]
    at, run = at[frequent], place[frequent]  # pairs that may be frequent, and a number for each phrase that begins there
    begins = np.zeros(len(ids) + 1, bool)
    begins[at] = True
    for n in range(3, max(lengths) + 1):
        more = begins[at + n - 2]  # the last two words are such a pair too
        at, run = at[more], run[more]
        keys, place, counts = np.unique(run * len(vocabulary) + ids[at + n - 1], return_inverse=True, return_counts=True)
        phrases = pc.binary_join_element_wise(phrases.take(pa.array(keys // len(vocabulary))), names.take(pa.array(keys % len(vocabulary))), space)
        run = place
        yield n, phrases, counts


def exploded(docs: DataFrame, lengths: list[int], bitmaps: list[np.ndarray]) -> DataFrame:
    """(lang, n, phrase, a): counts of runs of ``lengths`` words that may be frequent, by slices of the texts."""
    sent = [docs.sparkSession.sparkContext.broadcast(b) for b in bitmaps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [b.value for b in sent] + [None, None]
        for batch in batches:
            for lang, data in slices(batch.column(1), batch.column(0)):
                for n, phrases, counts in counted_runs(data, lang, lengths, *maps[:2]):
                    k = len(phrases)
                    yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.nulls(k, pa.int32()).fill_null(0)), pa.array(np.full(k, n, np.int32)), phrases.cast(pa.large_string()).cast(pa.string()), pa.array(counts.astype(np.int64))], ["lang", "n", "phrase", "a"])

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lean(run), COUNTED)


def frequent(rows: DataFrame, least: int) -> DataFrame:
    """Counts added up; of phrases those with ``least`` or more."""
    return rows.groupBy("lang", "n", "phrase").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | (F.col("n") == 0))


def bitmap(rows: DataFrame) -> np.ndarray:
    """Bytes of ``BITS`` bits, with those set that hashes of the rows' phrases fall on."""
    bit = F.crc32(F.concat("lang", F.lit(" "), "phrase").cast("binary")) % BITS
    parts = rows.where("n > 0").groupBy(F.floor(bit / CHUNK).alias("at")).agg(F.bitmap_construct_agg((bit % CHUNK).cast("long")).alias("bits")).collect()  # BITS / CHUNK rows at most
    out = np.zeros(BITS // 8, np.uint8)
    for p in parts:
        out[p["at"] * CHUNK // 8 : (p["at"] + 1) * CHUNK // 8] = np.frombuffer(p["bits"], np.uint8)
    return out


def exact(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """Each phrase (lang, n, phrase, a) with l, r and score of its lowest-scoring cut; of equal ones the first."""
    words = F.split("phrase", " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    cuts = cuts.withColumn("left", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ")).withColumn("right", F.array_join(F.slice(words, F.col("k") + 1, F.col("n") - F.col("k")), " "))
    l = counts.select(F.col("lang"), F.col("phrase").alias("left"), F.col("a").alias("l"))
    r = counts.select(F.col("lang"), F.col("phrase").alias("right"), F.col("a").alias("r"))
    both = cuts.join(l, ["lang", "left"]).join(r, ["lang", "right"])
    both = both.withColumn("wide", F.lit(2_000_000).cast("decimal(7,0)") * exact(F.col("a"))).withColumn("parts", exact(F.col("l")) + exact(F.col("r")))
    lowest = F.min(F.struct(F.expr("wide div parts").alias("score"), "k", "l", "r"))
    return both.groupBy("lang", "n", "phrase", "a").agg(lowest.alias("cut")).select("lang", "n", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covered(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer): phrases that are another without its first or last word, and the largest count of such another."""
    words = F.split("phrase", " ")
    shorter = F.array(F.array_join(F.slice(words, F.lit(1), F.col("n") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("n") - 1), " "))
    return phrases.where("n > 2").select("lang", F.explode(shorter).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, least: int = 30, max_n: int = 4, within: int = 80, first: int = 2000) -> DataFrame:
    """The ``first`` collocations of each language: lang, rank, phrase, a, l, r, n, score, words.

    A phrase has 2 to ``max_n`` words, occurs ``least`` times or more, and is not in a
    longer one with ``within`` percent of its count or more. a: its count; l, r: those of
    the two parts of its lowest-scoring cut; n: all words of the language; score:
    floor(2000000 a / (l + r)). Order: score, then a (largest first), then the phrase's bytes.
    """
    return finished(docs.sparkSession, "collocations", lambda: _collocations(pick(docs, "lang", "text"), least, max_n, within, first))


def _collocations(docs: DataFrame, least: int, max_n: int, within: int, first: int) -> DataFrame:
    words = written(frequent(exploded(docs, [1], []), least), "words")
    levels, bitmaps = [words], [bitmap(words)]
    levels.append(written(frequent(exploded(docs, [2], bitmaps), least), "pairs"))
    if max_n > 2:
        bitmaps.append(bitmap(levels[1]))
        levels.append(written(frequent(exploded(docs, [*range(3, max_n + 1)], bitmaps), least), "runs"))
    counts = reduce(DataFrame.unionByName, levels).where("n > 0")
    phrases = counts.where("n > 1")
    judged = scored(phrases, counts).alias("p").join(covered(phrases).alias("c"), (F.col("p.lang") == F.col("c.lang")) & (F.col("p.phrase") == F.col("c.phrase")) & (exact(F.col("c.longer")) * 100 >= exact(F.col("p.a")) * within), "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = judged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first).withColumnRenamed("n", "words")
    totals = words.where("n = 0").select("lang", F.col("a").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score", "words")
