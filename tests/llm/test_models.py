"""Quality, language and toxicity: held-out accuracy, determinism, odd rows."""

import random

import numpy as np
import pytest
import zstandard

from quern.llm import labelled, language, quality, queries, toxicity
from quern.llm.labelled import Sample
from tests.llm.cases import ODD, clashing

WORDS = ["".join(random.Random(i).choice(["the", "er", "ou", "in", "an", "es", "re", "th"]) for _ in range(3)) for i in range(400)]


def prose(r, n=120):
    return " ".join(r.choice(WORDS) for _ in range(n)) + "."


def junk(r):
    return " ".join(r.choice(WORDS).upper() + "!!" for _ in range(80)) if r.random() < 0.5 else " ".join([r.choice(WORDS)] * 90)


def area(y, p):
    rank = np.argsort(np.argsort(p)) + 1
    y = np.asarray(y)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_quality_held_out():
    r = random.Random(5)
    rows = [(prose(r), 1) if r.random() < 0.8 else (junk(r), 0) for _ in range(600)]
    sample = Sample([t for t, _ in rows[:400]], [y for _, y in rows[:400]], {1: 320, 0: 80})
    model = quality.fit(sample)
    p = quality.scores(model, quality.Compressors(model.good, model.bad), [t for t, _ in rows[400:]])
    y = [y for _, y in rows[400:]]
    assert area(y, p) > 0.98
    assert np.mean((p >= 0.3) == np.array(y)) > 0.95


def test_quality_odd(spark):
    model = quality.fit(Sample([prose(random.Random(i)) for i in range(40)] + [junk(random.Random(i)) for i in range(40)], [1] * 40 + [0] * 40, {1: 40, 0: 40}))
    rows = quality.scored(clashing(spark, ODD).drop("score"), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    same = {r.text: set() for r in rows}
    for r in rows:
        same[r.text].add(r.score)
    assert all(len(s) == 1 for s in same.values())
    assert quality.fit(Sample([], [], {})).prior == 0.0
    assert {r.score for r in quality.scored(clashing(spark, ODD).drop("score"), quality.fit(Sample(["a b"], [1], {1: 1}))).collect()} == {1.0}


LANGS = {"xx": "bcdfg", "yy": "klmnp", "zz": "rstvw"}


def text_in(lang, r, n=60):
    return " ".join("".join(r.choice(LANGS[lang]) + r.choice("aeiou") for _ in range(3)) for _ in range(n))


def test_language_held_out():
    r = random.Random(6)
    sample = Sample([text_in(k, r) for k in LANGS for _ in range(60)], [k for k in LANGS for _ in range(60)], {})
    model = language.fit(sample, epochs=6)
    tests = [(k, text_in(k, r, n)) for k in LANGS for n in (4, 20, 200) for _ in range(20)]
    got, score = language.predicted(model, [t.encode() for _, t in tests])
    assert np.mean([g == k for g, (k, _) in zip(got, tests, strict=True)]) > 0.97
    assert ((score > 0) & (score <= 1)).all()


def test_language_uses_the_whole_text():
    r = random.Random(7)
    model = language.fit(Sample([text_in(k, r) for k in LANGS for _ in range(60)], [k for k in LANGS for _ in range(60)], {}), epochs=6)
    assert language.predicted(model, [(text_in("xx", r, 100) + " " + text_in("yy", r, 2000)).encode()])[0] == ["yy"]


def test_folded_tables_equal_the_convolution():
    r = np.random.default_rng(0)
    emb = r.normal(size=(256, language.EMBEDDING)).astype(np.float32)
    filters = {w: r.normal(size=(w, language.EMBEDDING, language.FILTERS)).astype(np.float32) for w in language.WIDTHS}
    n = len(language.WIDTHS) * language.FILTERS
    m = language.folded(["a", "b"], emb, filters, np.zeros(n, np.float32), np.eye(n, 2, dtype=np.float32), np.zeros(2, np.float32))
    x = r.integers(0, 256, (3, language.WINDOW)).astype(np.uint8)
    f = filters[language.WIDTHS[0]]
    raw = np.stack([sum(emb[x[:, i + k]] @ f[k] for k in range(f.shape[0])) for i in range(0, language.WINDOW - f.shape[0] + 1, 2)], 1).max(1)
    assert np.allclose(m.logits(x), np.maximum(raw, 0)[:, :2], atol=1e-3)


def test_language_odd(spark):
    r = random.Random(8)
    model = language.fit(Sample([text_in(k, r) for k in LANGS for _ in range(5)], [k for k in LANGS for _ in range(5)], {}), epochs=1)
    rows = language.identified(clashing(spark, ODD), model).collect()
    und = {r.doc_id for r in rows if r.language.lang_pred == "und"}
    assert und == {1, 2, 3} and all((r.language.score == 0) == (r.doc_id in und) for r in rows)
    assert {r.language.lang_pred for r in language.identified(clashing(spark, ODD), language.fit(Sample([], [], {}))).collect()} == {"und"}
    assert language.fit(Sample(["a"], ["qq"], {})).languages == ["qq"]


def insulted(r, words=("idiot", "moron", "scum")):
    ws = prose(r, 60).split()
    for _ in range(3):
        ws.insert(r.randrange(len(ws)), r.choice(words))
    return " ".join(ws)


def test_toxicity_held_out_and_misspelt():
    r = random.Random(9)
    rows = [(insulted(r), 1) if i % 3 == 0 else (prose(r, 60), 0) for i in range(900)]
    model = toxicity.fit(Sample([t for t, _ in rows[:600]], [y for _, y in rows[:600]], {1: 200, 0: 400}))
    score = toxicity.Scorer(model).scores
    y = [y for _, y in rows[600:]]
    assert area(y, score([t for t, _ in rows[600:]])) > 0.98
    wrong = [insulted(r, ("idiott", "morron", "idiiot")) for _ in range(60)]
    assert area([1] * 60 + [0] * 60, np.concatenate([score(wrong), score([prose(r, 60) for _ in range(60)])])) > 0.9


def test_toxicity_odd(spark):
    r = random.Random(10)
    model = toxicity.fit(Sample([insulted(r) for _ in range(20)] + [prose(r) for _ in range(20)], [1] * 20 + [0] * 20, {1: 20, 0: 60}), epochs=2)
    rows = toxicity.scored(clashing(spark, ODD).drop("score"), model).collect()
    assert all(0 <= x.score <= 1 for x in rows) and {x.score for x in rows if x.doc_id in (1, 2, 3)} == {0.25}
    assert toxicity.Scorer(toxicity.fit(Sample([], [], {}))).scores([None, "a b"]).tolist() == [0.0, 0.5]


def test_few_toxic_texts_are_enough():
    """Thirty toxic texts among three hundred: rows that tell nothing apart don't drown the few that do."""
    r = random.Random(12)
    rows = [(insulted(r), 1) if i % 10 == 0 else (prose(r, 150), 0) for i in range(600)]
    score = toxicity.Scorer(toxicity.fit(Sample([t for t, _ in rows[:300]], [y for _, y in rows[:300]], {1: 30, 0: 270}))).scores
    y, s = np.array([y for _, y in rows[300:]]), score([t for t, _ in rows[300:]])
    assert area(y, s) > 0.95


def test_toxicity_of_one_text_by_hand():
    """A text's score is the logistic of the mean of its distinct words' means of n-gram logits."""
    r = random.Random(13)
    model = toxicity.fit(Sample([insulted(r) for _ in range(60)] + [prose(r) for _ in range(60)], [1] * 60 + [0] * 60, {1: 60, 0: 60}))
    text = insulted(r) + " x Straße"
    words = set(toxicity.WORD.findall(text.lower()))
    logit = model.bias + sum(model.row_logits[toxicity.subwords([w])[0]].mean() for w in words) / (len(words) + toxicity.REST)
    assert toxicity.Scorer(model).scores([text])[0] == pytest.approx(1 / (1 + np.exp(-logit)))


def test_quality_of_one_text_by_hand():
    """A text's score is the logistic of the difference of its blocks' sizes under two dictionaries."""
    r = random.Random(14)
    model = quality.fit(Sample([prose(r) for _ in range(80)] + [junk(r) for _ in range(80)], [1] * 80 + [0] * 80, {1: 80, 0: 80}))
    for text in (prose(r), junk(r), "é" * 100):
        raw, sizes = text.encode(), []
        for d in (model.good, model.bad):
            c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(raw[i : i + quality.BLOCK])) for i in range(0, len(raw), quality.BLOCK)))
        z = model.weights[0] + model.weights[1] * 100 * (sizes[1] - sizes[0]) / len(raw)
        assert quality.scores(model, quality.Compressors(model.good, model.bad), [text])[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_subwords_are_those_of_the_word():
    rows, owner = toxicity.subwords(["abcd", "x", "abcd"])
    assert sorted(rows[owner == 0]) == sorted(rows[owner == 2])
    assert (owner == 0).sum() == 1 + 4 + 3 + 2 and (owner == 1).sum() == 1 + 1


def test_samples_leave_held_out_rows_alone(spark, sf):
    import zlib

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    s = labelled.sampled(docs, labels, "quality", labelled.fold(F.col("doc_id"), 5) != 0, 10, 10**6)
    texts = {r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    assert set(s.texts) <= texts and max(s.labels.count(k) for k in (0, 1)) <= 10


def test_queries(spark, sf):
    import zlib

    for name, k, rest in (("op3_quality", 5, 0), ("op4_language", 4, 2), ("op10_toxicity", 3, 1)):
        rows = queries.QUERIES[name](spark, sf).collect()
        assert len(rows) == 200
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % k == rest) and 0 <= r.score <= 1 for r in rows)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [(r.lang_pred, truth[r.doc_id]) for r in queries.op4_language(spark, sf).collect() if r.held_out]
    assert np.mean([a == b for a, b in got]) > 0.95
