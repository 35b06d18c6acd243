"""Secret scan: keyword automaton, anchored patterns at its hits only, then embedded checksums.

Null and empty texts have no spans. Positions are code points, ends exclusive. Rows are
handled one by one, so repeated rows, ties and long texts need no special case; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.memory import lean
from quern.llm.store import by_place, pick

#: Kinds in the order in which spans that begin together are listed.
BASE_KINDS = ("assign", "access", "hex")
CHECKED_KINDS = ("github", "npm")
KINDS = BASE_KINDS + CHECKED_KINDS

#: The patterns of the base kinds and of tokens that end in a checksum.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "npm_": "npm",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
}

SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def base62_crc(body: str) -> str:
    """Six base-62 digits of the body's CRC-32, as issuers append them."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


def matched(kind: str, text: str, at: int) -> tuple[int, bool] | None:
    """End of the match that begins exactly at ``at`` and whether it counts, or None."""
    if kind == "assign":
        m = ASSIGN.match(text, at)
        return m and (m.end(), len(m[2]) >= 12)
    if kind == "access":
        m = ACCESS.match(text, at)
        return m and (m.end(), m.end() - at >= 18)
    m = (GITHUB if kind == "github" else NPM).match(text, at)
    return m and (m.end(), base62_crc(m[1]) == m[2])


def spans(text: str | None, words: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of every span, in order; leftmost and non-overlapping within a kind."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = text.translate(_ASCII_LOWER)
    hits = sorted((end - size + 1, kind) for end, (size, kind) in words.iter(low))
    done, out = dict.fromkeys(KINDS, 0), []
    for at, kind in hits:
        if at >= done[kind] and (m := matched(kind, text, at)):
            done[kind] = m[0]
            if m[1]:
                out.append((at, KINDS.index(kind), m[0]))
    out += [(m.start(), KINDS.index("hex"), m.end()) for m in HEX.finditer(text)]
    return sorted(out)


#: Texts that are redacted at once.
ROWS = 500


@lean
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = automaton()
    for batch in batches:
        found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(t, words)] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _SPAN_TYPE)], names=["doc_id", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end in code points) of every row of ``docs(doc_id, text)``."""
    rows = pick(docs, "doc_id", "text")
    return rows.mapInArrow(_scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def joined(found: Column) -> Column:
    """Spans as ``kind:start:end`` joined by commas."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def of_kinds(found: Column, *kinds: str) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*kinds))


def redacted(text: str, found: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """``text`` with every maximal run of overlapping spans replaced by one mark."""
    out, at = [], 0
    for start, _, end in found:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


@lean
def _redact(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Column ``at`` redacted, some rows at a time."""
    words = automaton()
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            batch = whole.slice(lo, ROWS)
            texts = (t.as_py() for t in batch.column(at))
            done = pa.array([t if t is None else redacted(t, spans(t, words)) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([done if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced and, where there is such a column, ``n_chars`` counted anew."""
    plain, text = by_place(docs, "text")
    out = plain.mapInArrow(functools.partial(_redact, at=plain.columns.index(text)), plain.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn(by_place(docs, "n_chars")[1], F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.toDF(*docs.columns)
