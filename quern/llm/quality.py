"""Compression classifier: two zstandard dictionaries, one of good and one of bad labelled text.

A text is compressed with each dictionary in short blocks, all of which count: a block
finds its matches in the dictionary rather than in itself, so neither a text's length nor
its own repetitions hide which dictionary fits. The difference of the compressed sizes
over the raw size is the only input of a logistic curve, which is fitted on labelled texts
that are in neither dictionary and makes the score.

Null, empty and other texts without bytes get the share of good rows among the labels.
If the sample lacks a class, every text gets that share. Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from quern.llm.labelled import Sample
from quern.llm.memory import release
from quern.llm.store import by_place

#: Bytes compressed at once.
BLOCK = 128
LEVEL = 3
DICTIONARY_BYTES = 112 * 1024


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]
    prior: float


def blocks(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


class Compressors:
    """Sizes of texts under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.both = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def differences(self, texts: list[str | None]) -> np.ndarray:
        """For each text how much smaller the good dictionary makes it, over its size; NaN without bytes."""
        good, bad = self.both
        out = np.full(len(texts), np.nan)
        for i, text in enumerate(texts):
            if parts := blocks(text):
                out[i] = sum([len(bad(p)) - len(good(p)) for p in parts]) / sum(map(len, parts))
        return out


def curve_inputs(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x * 100])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def trained_dictionary(texts: list[str]) -> bytes:
    parts = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from: the text itself
        return b"".join(parts)[-DICTIONARY_BYTES:]


def fit(sample: Sample) -> Model:
    """Of each class every other text builds the dictionary, the rest fit the curve."""
    y = np.array([int(v) for v in sample.labels])
    n1, n0 = sample.counts.get(1, 0), sample.counts.get(0, 0)
    prior = n1 / max(1, n1 + n0)
    texts = [[t for t, v in zip(sample.texts, y, strict=True) if v == k] for k in (0, 1)]
    if min(map(len, texts)) < 2:
        return Model(b"", b"", [], prior)
    bad, good = (trained_dictionary(t[::2]) for t in texts)
    held = [(t, k) for k in (0, 1) for t in texts[k][1::2]]
    x = Compressors(good, bad).differences([t for t, _ in held])
    ok, label = ~np.isnan(x), np.array([k for _, k in held])
    if not ok.any():
        return Model(b"", b"", [], prior)
    w = logistic(curve_inputs(x[ok]), label[ok])
    rate = len(texts[1][1::2]) / max(1, len(texts[0][1::2]))
    w[0] += np.log(max(n1, 1) / max(n0, 1) / rate)
    return Model(good, bad, w.tolist(), prior)


def scores(model: Model, compressors: Compressors, texts: list[str | None]) -> np.ndarray:
    x = compressors.differences(texts)
    p = 1 / (1 + np.exp(-np.clip(curve_inputs(x) @ np.array(model.weights), -30, 30)))
    return np.where(np.isnan(x), model.prior, p)


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that its text is good in column ``out``, whatever other columns there are."""
    plain, name = by_place(docs, text)
    if not model.weights:
        return plain.withColumn(out, F.lit(model.prior)).toDF(*docs.columns, out)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES at most

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressors = Compressors(sent.value.good, sent.value.bad)
        for texts in batches:
            yield pd.Series(scores(sent.value, compressors, texts.tolist()))
        release()

    return plain.withColumn(out, score(name)).toDF(*docs.columns, out)
