"""Token ids of whole texts with the tokenizers library, each distinct piece of a slice of texts encoded once.

The pre-tokenizer of a byte-level BPE never crosses the boundary before a single space
that follows a character and precedes a non-space, so a text may be cut at its spaces
and the pieces encoded apart. Texts in which a space stands next to other white space are
encoded whole. Arrow cuts a slice of texts into pieces and numbers the distinct ones; each
of these is encoded, and the ids of all pieces are gathered by number. Pieces made of plain
Latin words, ASCII digits and signs, and single line ends have known pre-tokens, which go
straight to the library's BPE model, some at once with a byte between them that is part of
no merge; any other piece goes through the whole tokenizer.
Tests hold all of this against encoding whole texts.

The strings of special tokens in a text count as ordinary text (``encode_special_tokens``),
as the tokenizer files' own description asks, so that no text can hold an end id.
"""

from __future__ import annotations

import codecs
import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Pre-tokens whose ids a worker keeps (about 40 bytes each); once there are more, half as many stay.
CACHED = 300_000
#: UTF-8 bytes of the texts cut at once, besides the last of them.
SLICE_BYTES = 3 << 20
#: Letters of plain words: Basic Latin to Latin Extended-B. Signs: ASCII without the apostrophe.
LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
SIGNS = r"!-&(-/:-@\[-`{-~"
PLAIN = rf"^ ?[{LETTERS}0-9{SIGNS}]+(\n[{LETTERS}0-9{SIGNS}]+)*$"
PART = rf" ?[{LETTERS}]+| ?[0-9]+| ?[{SIGNS}]+|\n"
#: Stands between the pre-tokens of plain pieces, which can't hold it.
MARK = "\x01"
#: New pre-tokens that the model sees at once, with marks between them.
TOGETHER = 32
#: A space beside other white space as either side's rules have it, or at the end.
UNSAFE = r"  | [\t\n\r\x0b\x0c\x1c-\x1f]| $|[\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

SPACE, NOTHING = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next from U+0100."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class Encoder:
    """Encodes texts to arrays of ids; keep one for each Python worker."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # what comes here is new, as a rule
        self.size = 2 if self.tokenizer.get_vocab_size() <= 65536 else 4
        self.dtype = np.dtype(f"<u{self.size}")
        self.letters = "".join(byte_letters())
        mark = self.letters[ord(MARK)]
        alone = [t for t in self.tokenizer.get_vocab() if mark in t] == [mark]
        self.mark = self.model.token_to_id(mark) if alone else None  # a token with the mark inside might come of a merge
        self.code = {2: "H", 4: "I"}[self.size]
        self.kept, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.uses = np.zeros(0, np.int32)

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def model_ids(self, parts: str) -> list[int]:
        """Ids by the model, which sees the bytes of a pre-token, or of some with marks between them, as letters."""
        return [t.id for t in self.model.tokenize(codecs.charmap_decode(parts.encode(), "strict", self.letters)[0])]

    def part_ids(self, parts: pa.Array) -> pa.Array:
        """Ids (large_binary) of each of some single pre-tokens."""
        if self.mark is None:
            return pa.array([array(self.code, self.model_ids(p)).tobytes() for p in strings(parts)], pa.large_binary())
        flat, some = array(self.code), strings(parts)
        for lo in range(0, len(some), TOGETHER):  # no merge goes over a mark, so each has the ids that it has alone
            flat.extend(self.model_ids(MARK.join(some[lo : lo + TOGETHER]) + MARK))
        ids = np.array(flat, self.dtype)
        marks = np.flatnonzero(ids == self.mark)
        edges = np.append(0, marks - np.arange(marks.size)) * self.size
        return pa.Array.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(edges), pa.py_buffer(np.delete(ids, marks))])

    def looked_up(self, parts: pa.Array) -> pa.Array:
        """Ids of each of some distinct single pre-tokens, kept for later ones: those used in most slices, and last, stay longest."""
        at = pc.index_in(parts, self.kept)
        new = parts.filter(at.is_null())
        self.kept, self.ids = pa.concat_arrays([self.kept, new]), pa.concat_arrays([self.ids, self.part_ids(new)])
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.uses) + np.arange(len(new))
        self.uses = np.append(self.uses, np.zeros(len(new), np.int32))
        self.uses[at] += 1
        found = self.ids.take(pa.array(at))
        if len(self.kept) > CACHED:
            stay = pa.array(np.sort(np.argsort(self.uses, kind="stable")[len(self.uses) - CACHED // 2 :]))
            self.kept, self.ids, self.uses = self.kept.take(stay), self.ids.take(stay), self.uses[stay] // 2
        return found

    def piece_ids(self, pieces: pa.Array) -> pa.Array:
        """Ids (large_binary) of each of some distinct pieces, which begin with their space if they follow one."""
        plain = pc.match_substring_regex(pieces, PLAIN)
        lists = pc.split_pattern(pc.replace_substring_regex(pc.if_else(plain, pieces, NOTHING), PART, rf"\0{MARK}"), MARK)
        parts = lists.values.dictionary_encode()
        _, offsets, data = self.looked_up(parts.dictionary).take(parts.indices).buffers()
        edges = np.frombuffer(offsets, np.int64, len(parts) + 1)[lists.offsets.to_numpy()]
        known = pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(edges), data])
        other = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        if not other.size:
            return known
        at = np.arange(len(pieces))
        at[other] = len(pieces) + np.arange(other.size)
        return pa.concat_arrays([known, pa.array(map(self.whole, strings(pieces.take(pa.array(other)))), pa.large_binary())]).take(pa.array(at))

    def encode(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each slice of ``texts``: rows in it, the ids of all of them, and the edges (rows + 1) of each text's ids.

        Null counts as empty; ``end_id`` is put after each text.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE_BYTES)))
            yield hi - lo, *self.encoded(texts.slice(lo, hi - lo), end_id)
            lo = hi

    def encoded(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        unsafe = pc.match_substring_regex(texts, UNSAFE)
        lists = pc.split_pattern(pc.if_else(unsafe, NOTHING, texts), " ")
        numbered, edges = lists.values.dictionary_encode(), lists.offsets.to_numpy()
        number, begins = numbered.indices.to_numpy().astype(np.int64), edges[:-1]
        first, after = np.unique(number[begins]), numbered.dictionary  # the first piece of a text follows no space
        number[begins] = len(after) + np.searchsorted(first, number[begins])
        ids = self.piece_ids(pa.concat_arrays([pc.binary_join_element_wise(SPACE, after, NOTHING), after.take(pa.array(first))]))
        if (apart := np.flatnonzero(unsafe.to_numpy(zero_copy_only=False))).size:
            number[begins[apart]] = len(ids) + np.arange(apart.size)
            ids = pa.concat_arrays([ids, pa.array(map(self.whole, strings(texts.take(pa.array(apart)))), pa.large_binary())])
        _, offsets, data = ids.take(pa.array(number)).buffers()
        ends = np.frombuffer(offsets, np.int64, len(number) + 1)[edges] // self.size
        flat = np.frombuffer(data, self.dtype, ends[-1])
        return (flat, ends) if end_id is None else (np.insert(flat, ends[1:], end_id), ends + np.arange(ends.size))


def strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


@functools.cache
def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    return Encoder(path)
