"""Packing by lexical retrieval: a sharded BM25 index gives each seed its unused neighbours.

Documents become token ids with an end id. Whole windows of a long document are sequences
of their own. What is left of each document (under a window) is dealt to shards by two
of its telling tokens (a weighted min-hash), so that texts with rare words in common tend
to meet; a shard has a bounded number of remainders, however they are distributed. In a
shard, all terms of a seed query a BM25 index; the neighbours found fill its window
greedily, best first, until it is full or no unused document scores. They are looked at
some at a time: if one of these does not fit, the best such is cut at the end, and its
rest returns to the pool, so windows are full; only documents that share no term with the
seed are taken by order. The last window of a shard is cut at powers of two.

Document frequencies and mean length are of the whole corpus. Null and empty texts have
the end id alone. Repeated rows are packed each for itself; doc_id may be null. Equal
scores go by place in the shard. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.memory import lean
from quern.llm.store import pick, written
from quern.llm.tokens import encoder

WINDOW = 2048
#: Remainders of one shard, about.
SHARD_ROWS = 4096
#: Neighbours looked at in one go; if all of them fit, the next best follow.
NEIGHBOURS = 64
K1, B = 1.2, 0.75
#: Terms that one remainder in so many has are kept as rows of a dense matrix, the most frequent first, up to so many cells.
DENSE_SHARE, DENSE_CELLS = 8, 4 << 20

_PIECE = "doc_tokens long, start long, length long, ids binary, sequence_id long, offset long"


@lean
def _tokens(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(tokenizer)
    for batch in batches:
        at = 0
        for rows, flat, edges in enc.encode(batch.column("text"), end_id):
            n = np.diff(edges)
            middle = edges[:-1] + n // WINDOW * WINDOW
            spans = [zip(a.tolist(), b.tolist(), strict=True) for a, b in ((edges[:-1], middle), (middle, edges[1:]))]
            columns = [batch.column("doc_id").slice(at, rows), pa.array(n, pa.int64()), *[pa.array([flat[a:b].tobytes() for a, b in s], pa.binary()) for s in spans]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "doc_tokens", "windows", "rest"])
            at += rows


@lean
def _frequencies(batches: Iterator[pa.RecordBatch], dtype: str, vocabulary: int) -> Iterator[pa.RecordBatch]:
    df = np.zeros(vocabulary, np.int64)
    for batch in batches:
        docs = [np.frombuffer(w + r, dtype) for w, r in zip(batch.column("windows").to_pylist(), batch.column("rest").to_pylist(), strict=True)]
        for lo in range(0, len(docs), 64):
            part = docs[lo : lo + 64]
            kind = np.uint32 if 64 * vocabulary < 2**32 else np.int64  # short keys sort faster
            key = np.concatenate(part).astype(kind) + np.repeat((np.arange(len(part)) * vocabulary).astype(kind), [d.size for d in part])
            key.sort()  # np.unique would hash, which takes longer
            df += np.bincount(key[np.append(True, key[1:] != key[:-1])] % vocabulary, minlength=vocabulary)
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], names=["token", "df"])


@lean
def _windows(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    """Each whole window of a document as a sequence of its own; these have negative numbers."""
    number = -1 - (TaskContext.get().partitionId() << 32)
    size = np.dtype(dtype).itemsize * WINDOW
    for batch in batches:
        out = []
        for doc_id, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "windows")), strict=True):
            for at in range(0, len(data), size):
                out.append((doc_id, n, at // size * WINDOW, WINDOW, np.frombuffer(data[at : at + size], dtype).astype("<u4").tobytes(), number, 0))
                number -= 1
        yield from as_batch(out, batch.schema.field("doc_id").type)


def as_batch(rows: list[tuple], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "doc_tokens", "start", "length", "ids", "sequence_id", "offset"]
    types = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    for lo in range(0, len(rows), 2000):
        columns = zip(*rows[lo : lo + 2000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


@lean
def _telling(batches: Iterator[pa.RecordBatch], dtype: str, idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds the two tokens with the least draws, drawn so that rare tokens tend to win."""
    draw = np.random.default_rng(11).exponential(size=idf.size) / np.maximum(idf, 1e-3)
    rank = np.empty(idf.size, np.int64)
    rank[np.argsort(draw, kind="stable")] = np.arange(idf.size)
    for batch in batches:
        first, second = [], []
        for data in batch.column("rest").to_pylist():
            r = rank[np.frombuffer(data, dtype)]
            least = int(r.min())
            first.append(least)
            second.append(int(r[r != least].min(initial=idf.size)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=[*batch.schema.names, "t1", "t2"])


class Shard:
    """BM25 index over the remainders of one shard, and what is left of each."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        n = len(docs)
        self.size = np.array([d.size for d in docs])
        kind = np.uint32 if idf.size * n < 2**32 else np.int64  # short keys sort faster
        key, tf = np.unique(np.concatenate(docs).astype(kind) * kind(n) + np.repeat(np.arange(n, dtype=kind), self.size), return_counts=True)
        term, doc = (key // kind(n)).astype(np.int64), (key % kind(n)).astype(np.int64)
        self.terms = idf.size
        self._index(term, doc, idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.size[doc] / mean)))
        self.start = np.zeros(n, np.int64)
        self.left = self.size.copy()

    def _index(self, term: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> None:
        """Which terms each document has; weights of frequent terms as a dense matrix, of the others as lists by term."""
        self.term, self.doc, self.weight = term, doc, weight
        own = np.argsort(doc, kind="stable")
        self.own_terms = term[own]
        self.own_at = np.searchsorted(doc[own], np.arange(self.size.size + 1))
        self.live = np.flatnonzero(np.diff(self.own_at))
        self.indexed = self.live.size
        length = np.bincount(term, minlength=self.terms)
        often = np.argsort(-length, kind="stable")[: DENSE_CELLS // max(1, self.indexed)]
        often = np.sort(often[length[often] >= max(2, self.indexed / DENSE_SHARE)])
        self.row = np.full(self.terms, -1)
        self.row[often] = np.arange(often.size)
        self.dense = np.zeros((often.size, self.indexed), np.float32)
        at = self.row[term]
        column = np.zeros(self.size.size, np.int64)
        column[self.live] = np.arange(self.indexed)
        in_rows, in_lists = at >= 0, at < 0
        self.dense[at[in_rows], column[doc[in_rows]]] = weight[in_rows]
        self.list_doc, self.list_weight = doc[in_lists], weight[in_lists]
        self.list_at = np.searchsorted(term[in_lists], np.arange(self.terms + 1))

    def drop_used(self) -> None:
        """Used documents leave the index once they are half of it."""
        if 2 * np.count_nonzero(self.left) < self.indexed:
            keep = self.left[self.doc] > 0
            self._index(self.term[keep], self.doc[keep], self.weight[keep])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of each unused document for all terms of the seed; 0 for others."""
        mine = self.own_terms[self.own_at[seed] : self.own_at[seed + 1]]
        row = self.row[mine]
        rare = mine[row < 0]
        begin = self.list_at[rare]
        length = self.list_at[rare + 1] - begin
        end = np.cumsum(length)
        at = np.repeat(begin - end + length, length) + np.arange(length.sum())  # places of all their lists
        score = np.bincount(self.list_doc.take(at), self.list_weight.take(at), self.size.size).astype(float, copy=False)
        score[self.live] += self.dense.take(row[row >= 0], 0).sum(0)  # not by matrix product: its threads would take other tasks' cores
        score[self.left == 0] = 0
        score[seed] = 0
        return score

    def best(self, score: np.ndarray) -> list[int]:
        """The next ``NEIGHBOURS`` documents by score, best first."""
        found = np.flatnonzero(score)
        if found.size > NEIGHBOURS:
            least = -np.partition(-score[found], NEIGHBOURS - 1)[NEIGHBOURS - 1]
            found = found[score[found] >= least]
        return found[np.argsort(-score[found], kind="stable")][:NEIGHBOURS].tolist()

    def neighbours(self, seed: int) -> list[int]:
        """The best unused documents that share terms with the seed, best score first."""
        return self.best(self.scores(seed))

    def take(self, doc: int, room: int) -> tuple[int, int, int]:
        """(document, start, length) of the next part of ``doc``, at most ``room`` long."""
        n = min(room, int(self.left[doc]))
        at = int(self.start[doc])
        self.start[doc] += n
        self.left[doc] -= n
        return doc, at, n

    def sequences(self) -> Iterator[list[tuple[int, int, int]]]:
        n, place = self.size.size, 0
        while True:
            while place < n and not self.left[place]:
                place += 1
            if place == n:
                return
            self.drop_used()
            made = [self.take(place, WINDOW)]
            room = WINDOW - made[0][2]
            over = None
            score = self.scores(place) if room else None
            while room and over is None and (found := self.best(score)):
                score[found] = 0
                for doc in found:
                    if self.left[doc] <= room:
                        made.append(self.take(doc, room))
                        room -= made[-1][2]
                        if not room:
                            break
                    elif over is None:
                        over = doc
            if room and over is not None:
                made.append(self.take(over, room))
                room = 0
            at = place
            while room and at < n:  # no unused document shares a term: whatever comes next
                if self.left[at]:
                    made.append(self.take(at, room))
                    room -= made[-1][2]
                at += 1
            if not room:
                yield made
            else:
                yield from at_powers(made, WINDOW - room)


def at_powers(parts: list[tuple[int, int, int]], total: int) -> Iterator[list[tuple[int, int, int]]]:
    """Cut a last, short window into sequences whose lengths are powers of two, largest first."""
    parts = list(parts)
    while total:
        room = size = 1 << (total.bit_length() - 1)
        made = []
        while room:
            doc, start, n = parts.pop(0)
            k = min(n, room)
            made.append((doc, start, k))
            if k < n:
                parts.insert(0, (doc, start + k, n - k))
            room -= k
        total -= size
        yield made


@lean
def _pack(batches: Iterator[pa.RecordBatch], dtype: str, idf: np.ndarray, mean: float) -> Iterator[pa.RecordBatch]:
    rows, id_type = [], pa.int64()
    for batch in batches:
        id_type = batch.schema.field("doc_id").type
        rows += zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "rest")), strict=True)
    number = TaskContext.get().partitionId() << 32
    for lo in range(0, len(rows), 2 * SHARD_ROWS):
        some = rows[lo : lo + 2 * SHARD_ROWS]
        docs = [np.frombuffer(r[2], dtype) for r in some]
        out = []
        for made in Shard(docs, idf, mean).sequences():
            offset = 0
            for doc, start, n in made:
                doc_id, tokens, _ = some[doc]
                out.append((doc_id, tokens, tokens - docs[doc].size + start, n, docs[doc][start : start + n].astype("<u4").tobytes(), number, offset))
                offset += n
            number += 1
        yield from as_batch(out, id_type)


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Pieces of all documents in sequences of at most ``WINDOW`` tokens.

    Columns: doc_id, doc_tokens (with the end id), start (in the document), length, ids
    (little-endian uint32), sequence_id, offset (in the sequence).
    """
    enc = encoder(tokenizer)
    dtype, vocabulary = enc.dtype.str, max(enc.tokenizer.get_vocab_size(), end_id + 1)
    docs = pick(docs, "doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    tokens = written(docs.mapInArrow(functools.partial(_tokens, tokenizer=tokenizer, end_id=end_id), f"doc_id {id_type}, doc_tokens long, windows binary, rest binary"), "tokens")

    # one number for each id of the vocabulary comes to the driver
    df = np.zeros(vocabulary)
    counts = tokens.select("windows", "rest").mapInArrow(functools.partial(_frequencies, dtype=dtype, vocabulary=vocabulary), "token long, df long")
    for r in counts.groupBy("token").agg(F.sum("df").alias("df")).collect():
        df[r["token"]] = r["df"]
    rest = tokens.where(F.length("rest") > 0).select("doc_id", "doc_tokens", "rest")
    every, n, mean = tokens.agg(F.count("*"), F.count_if(F.length("rest") > 0), F.avg(F.when(F.length("rest") > 0, F.length("rest") / enc.size))).first()
    idf = np.log(1 + (every - df + 0.5) / (df + 0.5))

    pieces = f"doc_id {id_type}, {_PIECE}"
    whole = tokens.where(F.length("windows") > 0).select("doc_id", "doc_tokens", "windows").mapInArrow(functools.partial(_windows, dtype=dtype), pieces)
    told = rest.mapInArrow(functools.partial(_telling, dtype=dtype, idf=idf), f"doc_id {id_type}, doc_tokens long, rest binary, t1 long, t2 long")
    dealt = told.repartitionByRange(max(1, -(-n // SHARD_ROWS)), "t1", "t2", F.xxhash64("doc_id", "doc_tokens"))
    return whole.unionByName(dealt.select("doc_id", "doc_tokens", "rest").mapInArrow(functools.partial(_pack, dtype=dtype, idf=idf, mean=mean or 1.0), pieces))
