"""Tokens, token files and packing: exact round trips."""

import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import packing, queries, token_files, tokens
from quern.llm.tokens import Encoder
from tests.llm.cases import ODD, clashing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENC = Encoder(PATH)
WHOLE = Tokenizer.from_file(PATH)
WHOLE.encode_special_tokens = True


def ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=30), st.text("aB é\n\t .,'!%7½ \x1c\x85²中—", max_size=30), st.lists(st.sampled_from(["the", "foo.", "x\ny", "x.\n", "\ny", "it's", "été,", "1,", "%%a$$", "", "<|endoftext|>"]), max_size=8).map(" ".join)))
def test_pieces_equal_whole_texts(text):
    (_, got, edges), want = next(ENC.encode(pa.array([text, None, text], pa.string()), 7)), [*ids(text), 7]
    assert got.tolist() == [*want, 7, *want] and edges.tolist() == [0, len(want), len(want) + 1, 2 * len(want) + 1]


def test_new_pre_tokens_go_to_the_model_together():
    """Few calls for many new words, none for words that are kept."""
    enc, calls = Encoder(PATH), []
    model = enc.model
    enc.model = SimpleNamespace(tokenize=lambda s: (calls.append(s), model.tokenize(s))[1])
    text = " ".join(f"w{chr(97 + a)}{chr(97 + b)}é" for a in range(26) for b in range(26))
    for _ in range(2):
        assert next(enc.encode(pa.array([text])))[1].tolist() == ids(text)
        assert len(calls) == -(-676 // tokens.TOGETHER)


@pytest.mark.parametrize("marked", [True, False])
@pytest.mark.parametrize("kept", [1, 4, 1000])
def test_ids_after_words_were_let_go(marked, kept, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", kept)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 32)
    enc, r = Encoder(PATH), np.random.default_rng(5)
    enc.mark = enc.mark if marked else None  # None: a vocabulary whose merges hold the mark
    words = ["Straße", "the", "été\nx", "1,", "<|endoftext|>", "a\x01b", "ā", "中", "thereof", ""]
    texts = [" ".join(r.choice(words, 6)) for _ in range(60)]
    assert [x for _, flat, _ in enc.encode(pa.array(texts)) for x in flat.tolist()] == [x for t in texts for x in ids(t)]
    assert len(enc.kept) == len(enc.ids) == len(enc.uses) <= kept


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1001])
@pytest.mark.parametrize("top", [2, 300, 50_000, 1 << 20, 2**32 - 1])
def test_codes_round_trip(n, top, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 64)
    v = np.random.default_rng(n).integers(0, top, n, dtype=np.uint32)
    control, data = token_files.coded(v)
    assert len(control) == -(-n // 4)
    assert (token_files.decoded(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == v).all()


def test_frequent_ids_get_low_ranks():
    order, rank = token_files.ranked(np.array([7, 7, 7, 2, 2, 9], np.uint16))
    assert order.tolist() == [7, 2, 9] and rank[[7, 2, 9]].tolist() == [0, 1, 2]


@pytest.mark.parametrize("file_tokens", [1, 10, 1 << 23])
def test_files_hold_all_documents_in_order(spark, tmp_path, file_tokens):
    folder = token_files.write_token_files(clashing(spark, ODD), PATH, 2, f"file://{tmp_path}/t", file_tokens)
    files = spark.read.parquet(f"{folder}/manifest").collect()
    assert len({f.file for f in files}) == len(files) and all(f.n_docs == 1 or f.n_tokens <= file_tokens for f in files)
    (tmp_path / "t/files/0.qtok").write_bytes(token_files.packed_file([1], [1], np.array([5], np.uint16)))  # of an attempt that failed
    rows = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    want = sorted(ODD, key=lambda x: (-1 if x[0] is None else x[0], x[1] or ""))
    at = 0
    for r, (doc_id, text) in zip(rows, want, strict=True):
        expected = np.array([*ids(text), 2], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (doc_id, at, len(expected) // 4, expected)
        at += r.n_tokens
    empty = token_files.write_token_files(clashing(spark, []), PATH, 2, f"file://{tmp_path}/e")
    assert token_files.read_token_files(spark, empty).collect() == []


def check_pieces(pieces, rows):
    """Each id in exactly one piece; sequences gapless; no padding."""
    want = defaultdict(list)
    for i, t in rows:
        want[i].append([*ids(t), 1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(want)
    for i, ps in by_doc.items():
        assert sum(p.length for p in ps) == sum(map(len, want[i]))
        for p in ps:
            assert any(bytes(p.ids) == np.array(w[p.start : p.start + p.length], "<u4").tobytes() and p.doc_tokens == len(w) for w in want[i])
        if len(want[i]) == 1:
            assert sorted(x for p in ps for x in range(p.start, p.start + p.length)) == list(range(len(want[i][0])))
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == packing.WINDOW or at < packing.WINDOW and at & (at - 1) == 0


def test_packing_odd_rows(spark):
    check_pieces(packing.packed(clashing(spark, ODD), PATH).collect(), ODD)
    assert packing.packed(clashing(spark, []), PATH).collect() == []


def test_packing_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op2_packing(spark, sf).collect()
    want = {i: [*ids(t), 1] for i, t in docs}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in rows) == sum(map(len, want.values()))


def test_frequencies_count_each_document_once():
    docs = [np.random.default_rng(k).integers(0, 30, k).astype("<u2") for k in range(1, 150)]
    batch = pa.RecordBatch.from_arrays([pa.array([d[:k].tobytes() for d in docs], pa.binary()) for k in (9, 0)], names=["windows", "rest"])
    (got,) = packing._frequencies(iter([batch]), dtype="<u2", vocabulary=40)
    want = np.bincount(np.concatenate([np.unique(d[:9]) for d in docs]), minlength=40)
    assert dict(zip(got["token"].to_pylist(), got["df"].to_pylist(), strict=True)) == {t: n for t, n in enumerate(want.tolist()) if n}


def test_neighbours_are_lexical():
    """A seed's window takes texts of its own kind first."""
    r = np.random.default_rng(0)
    docs = [r.integers(1000 * (k % 4), 1000 * (k % 4) + 300, 300).astype(np.uint16) for k in range(80)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=5000)
    shard = packing.Shard(docs, np.log(1 + (80 - df + 0.5) / (df + 0.5)), 300.0)
    assert all(k % 4 == 2 for k in shard.neighbours(2)[:15])
    made = list(shard.sequences())
    assert sum(n for s in made for _, _, n in s) == 80 * 300
    alike = [len({d % 4 for d, _, _ in s}) == 1 for s in made[:8]]
    assert sum(alike) >= 6


def shard_of(docs, terms):
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=terms)
    return packing.Shard(docs, np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)), float(np.mean([d.size for d in docs])))


def test_short_texts_fill_windows_by_retrieval():
    """Far more than 64 short neighbours fit a window: they go on being retrieved."""
    r = np.random.default_rng(1)
    docs = [r.integers(1000 * (k % 4), 1000 * (k % 4) + 50, 8).astype(np.uint16) for k in range(2048)]
    made = list(shard_of(docs, 4000).sequences())
    assert [sum(n for _, _, n in s) for s in made] == [packing.WINDOW] * 8
    first = made[0][: 1 + sum(bool(set(docs[0]) & set(d)) for d in docs[1:])]
    assert len(first) > 65 and all(set(docs[0]) & set(docs[d]) for d, _, _ in first)


def test_all_terms_of_a_seed_are_scored():
    """A document that shares only one of the seed's many terms, a common one, is found; scores are those of brute force."""
    r = np.random.default_rng(2)
    seed = np.arange(200, dtype=np.uint16)
    docs = [seed, *[np.append(r.integers(300, 900, 20), 199 if k % 2 else 901).astype(np.uint16) for k in range(40)]]
    shard = shard_of(docs, 1000)
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1000)
    idf, mean = np.log(1 + (41 - df + 0.5) / (df + 0.5)), np.mean([d.size for d in docs])
    want = [0.0]
    for d in docs[1:]:
        tf = {t: int((d == t).sum()) for t in set(d.tolist()) & set(seed.tolist())}
        want.append(sum(idf[t] * f * (packing.K1 + 1) / (f + packing.K1 * (1 - packing.B + packing.B * d.size / mean)) for t, f in tf.items()))
    assert np.allclose(shard.scores(0), want)
    assert sorted(shard.neighbours(0)) == list(range(2, 41, 2))


def test_last_window_is_cut_at_powers():
    parts = [(0, 0, 700), (1, 5, 640)]
    sizes = [sum(n for _, _, n in s) for s in packing.at_powers(parts, 1340)]
    assert sizes == [1024, 256, 32, 16, 8, 4]


def test_token_files_query(spark, sf):
    """The query against the tokenizers library, one text at a time."""
    want, start = [], 0
    for d, text in sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()):
        own = np.array([*ids(text or ""), 2], "<u4")
        want.append((d, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert sorted(tuple(r) for r in queries.op6_token_files(spark, sf).collect()) == want
