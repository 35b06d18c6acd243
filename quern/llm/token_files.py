"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Each file holds a run of documents in ascending doc_id. Ids are replaced by their rank
in frequency over the whole file; two control bits give a rank's length of 1 to 4 bytes;
control bytes and data bytes lie apart. Decoding looks up the four lengths of each
control byte in a table and gathers bytes with numpy.

A partition of the sorted documents gives one file or more, each of at most ``file_tokens``
ids (a longer document: a file of its own), so a task holds one file's ids. Every attempt
of a task writes files of its own; the manifest, which Spark's committer writes, names those
of the attempts that counted, and only these are read.

Layout, little-endian: magic, then counts of documents, tokens, ranks and data bytes
(uint64 each), doc_id (int64) and its validity (uint8) and token count (int64) for each
document, the id of each rank (uint32), control bytes, data bytes.

Null and empty texts have the end id alone. A null doc_id sorts first; rows that share a
doc_id are ordered by text. An empty table gives no file.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.memory import lean
from quern.llm.store import new_folder, pick
from quern.llm.tokens import encoder

#: Fixed values of the format.
MAGIC = b"QTOKENS1"
SUFFIX = ".qtok"
MANIFEST = "file string, part long, place long, n_docs long, n_tokens long"
#: Tokens coded at once; a multiple of four.
BLOCK = 1 << 20
#: Ids after which a file ends, and bytes of ids in one batch of documents read back.
FILE_TOKENS, BATCH_BYTES = 1 << 23, 32 << 20

#: Row c: the byte lengths of the four ids that control byte c describes.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in descending frequency (ties: ascending id) and the rank of each token."""
    counts = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    for at in range(0, ids.size, BLOCK):
        counts += np.bincount(ids[at : at + BLOCK], minlength=counts.size)
    present = np.flatnonzero(counts)
    order = present[np.argsort(-counts[present], kind="stable")].astype("<u4")
    rank = np.zeros(counts.size, "<u4")
    rank[order] = np.arange(order.size)
    return order, rank


def coded(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of uint32 values."""
    control, data, wide = [], [], values.max(initial=0) > 0xFFFF
    for at in range(0, values.size, BLOCK):
        v = values[at : at + BLOCK].astype("<u4" if wide else "<u2")
        extra = (v > 0xFF).astype(np.uint8)
        if wide:
            extra += v > 0xFFFF
            extra += v > 0xFFFFFF
        padded = np.zeros(-(-v.size // 4) * 4, np.uint8)
        padded[: v.size] = extra
        four = padded.reshape(-1, 4)
        control.append((four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes())
        data.append(v.view(np.uint8).reshape(v.size, -1)[np.arange(v.itemsize) <= extra[:, None]].tobytes())
    return b"".join(control), b"".join(data)


def decoded(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` uint32 values behind control and data bytes (uint8 arrays)."""
    out, at = np.empty(n, "<u4"), 0
    data = np.concatenate([data, np.zeros(3, np.uint8)])
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        size = LENGTHS[control[lo // 4 : -(-hi // 4)]].reshape(-1)[: hi - lo]
        ends = np.cumsum(size, dtype=np.int64) + at
        start = ends - size
        v = data[start].astype("<u4")
        for k in range(1, int(size.max(initial=1))):
            longer = np.flatnonzero(size > k)
            v[longer] |= data[start[longer] + k].astype("<u4") << np.uint32(8 * k)
        out[lo:hi], at = v, int(ends[-1])
    return out


def packed_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    order, rank = ranked(ids)
    control, data = coded(rank[ids] if ids.size else np.zeros(0, "<u4"))
    head = np.array([len(doc_ids), ids.size, order.size, len(data)], "<u8").tobytes()
    return b"".join((MAGIC, head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes(), np.array(lengths, "<i8").tobytes(), order.tobytes(), control, data))


def unpacked_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, token counts and all ids of a file."""
    if content[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, tokens, ranks, size = (int(x) for x in np.frombuffer(content, "<u8", 4, 8))
    at = 40
    doc_ids = np.frombuffer(content, "<i8", docs, at).tolist()
    valid = np.frombuffer(content, np.uint8, docs, at := at + 8 * docs)
    lengths = np.frombuffer(content, "<i8", docs, at := at + docs)
    order = np.frombuffer(content, "<u4", ranks, at := at + 8 * docs)
    control = np.frombuffer(content, np.uint8, -(-tokens // 4), at := at + 4 * ranks)
    data = np.frombuffer(content, np.uint8, size, at + control.size)
    return [d if ok else None for d, ok in zip(doc_ids, valid, strict=True)], lengths, order[decoded(control, data, tokens)]


def _save(folder: str, content: bytes) -> str:
    """Store a file under a name of its own; returns the name."""
    store, path = fs.FileSystem.from_uri(folder)
    name = f"{uuid.uuid4().hex}{SUFFIX}"
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(content)
    return name


@lean
def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int, file_tokens: int) -> Iterator[pa.RecordBatch]:
    """Write this partition's files; a row for each: its name, place, documents and tokens."""
    enc, doc_ids, lengths, ids, saved = encoder(tokenizer), [], [], [], []

    def save() -> None:
        content = packed_file(doc_ids, lengths, np.concatenate(ids))
        saved.append((_save(folder, content), TaskContext.get().partitionId(), len(saved), len(doc_ids), sum(lengths)))
        doc_ids.clear(), lengths.clear(), ids.clear()

    for batch in batches:
        known, at = batch.column("doc_id").to_pylist(), 0
        for rows, flat, edges in enc.encode(batch.column("text"), end_id):
            lo = 0
            while lo < rows:
                room = max(0, file_tokens - sum(lengths))
                hi = int(np.searchsorted(edges, edges[lo] + room, "right")) - 1
                hi = min(rows, max(hi, lo if doc_ids else lo + 1))
                doc_ids += known[at + lo : at + hi]
                lengths += np.diff(edges[lo : hi + 1]).tolist()
                ids.append(flat[edges[lo] : edges[hi]].copy())
                if hi < rows:
                    save()
                lo = hi
            at += rows
    if doc_ids:
        save()
    columns = zip(*saved, strict=True) if saved else [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.string(), *[pa.int64()] * 4], strict=True)], names=["file", "part", "place", "n_docs", "n_tokens"])


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, file_tokens: int = FILE_TOKENS) -> str:
    """Encode every text, append ``end_id``, write files in ascending doc_id; returns the folder.

    ``folder/manifest`` lists each file: name, partition and place in it, documents, tokens.
    Files go through pyarrow's file systems: local or mounted folders, HDFS and object stores that it knows.
    """
    folder = folder or new_folder(docs.sparkSession, "tokens")
    rows = pick(docs, "doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    write = functools.partial(_write, folder=f"{folder}/files", tokenizer=tokenizer, end_id=end_id, file_tokens=file_tokens)
    rows.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


@lean
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
            doc_ids, lengths, ids = unpacked_file(content.as_buffer())
            edges, lo = np.append(0, np.cumsum(lengths)), 0
            while lo < len(doc_ids):  # some documents at a time; offsets of a batch are of 32 bits
                hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + BATCH_BYTES // 4, "right")) - 1)
                offsets = ((edges[lo : hi + 1] - edges[lo]) * 4).astype("<i4")
                raw = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets), pa.py_buffer(ids[edges[lo] : edges[hi]].astype("<u4"))])
                yield pa.RecordBatch.from_arrays([pa.array([file] * (hi - lo)), pa.array(doc_ids[lo:hi], pa.int64()), pa.array(edges[lo:hi], pa.int64()), pa.array(lengths[lo:hi], pa.int64()), raw], names=["file", "doc_id", "local_start", "n_tokens", "ids"])
                lo = hi


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32)."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    own = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    before = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("before"))
    inside = manifest.select("file", "part", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)).alias("inside"))
    bases = inside.join(before, "part").select("file", (F.col("before") + F.col("inside")).alias("base"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(f"{folder}/files").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    rows = files.mapInArrow(_read, "file string, doc_id long, local_start long, n_tokens long, ids binary")
    return rows.join(bases, "file").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")
