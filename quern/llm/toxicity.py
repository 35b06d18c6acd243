"""Toxicity: bags of subwords, averaged embeddings, linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams and of the word as a
whole, all hashed to a fixed number of rows; a text's vector is the mean over its distinct
words, so that a text which repeats one word is not judged by that word alone.
A misspelt word that was never seen still shares most n-grams with the word it stands for.

As softmax and means are linear, a text's logit is the mean of its words' logits, so
scoring keeps one number for each word. A text without words (null, empty, punctuation
alone) gets the score of the classes' frequencies. Labels of doc_ids that occur in
several rows count for each. If the sample lacks a class, all scores are the share of
toxic rows in it, or 0 without any.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.labelled import Sample
from quern.llm.memory import release
from quern.llm.store import by_place

WORD = re.compile(r"[^\W_]+")
SIZES = (3, 4, 5)
BUCKETS = 1 << 17
#: The mean word vector is multiplied by this in training, so that a few words can decide.
SCALE = 100.0
#: Words without meaning that are added to each text, so that a very short one does not hang on one word.
REST = 5
#: A row counts in full where its share of texts differs between the classes by so many standard errors, else by the square of its part of that.
SURE = 10.0
#: Rows that count less than this are left out.
LEAST_GAIN = 0.02
#: Words whose logit a worker keeps before it starts anew.
CACHED = 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed rows of every n-gram of the words (and of each whole word), and the word each belongs to."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.array([len(m) for m in marked])
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(codes.size) - starts[word]
    powers = np.cumprod(np.full(int(sizes.max()), _BASE))
    rows, owner = [np.add.reduceat(codes * powers[place], starts)], [np.arange(len(words))]
    for n in SIZES:
        if codes.size >= n:
            h = np.full(codes.size - n + 1, n, np.uint64)
            for k in range(n):
                h = h * _BASE + codes[k : codes.size - n + 1 + k]
            ok = word[: codes.size - n + 1] == word[n - 1 :]
            rows.append(h[ok])
            owner.append(word[: codes.size - n + 1][ok])
    h = np.concatenate(rows)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), np.concatenate(owner)


@dataclass
class Model:
    """Logit of each subword row (embedding times softmax weights) and the bias."""

    row_logits: np.ndarray
    bias: float
    prior: float

    def word_logits(self, words: list[str]) -> np.ndarray:
        rows, owner = subwords(words)
        return np.bincount(owner, self.row_logits[rows], len(words)) / np.bincount(owner, minlength=len(words))


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the rows and weights whose product with the embeddings is its mean word vector."""
    out = []
    for text in texts:
        ws = words_of(text)
        if not ws:
            out.append((np.zeros(0, np.int32), np.zeros(0, np.float32)))
            continue
        uniq = np.unique(np.array(ws, object))
        r, owner = subwords(uniq.tolist())
        w = (1 / (uniq.size + REST) / np.bincount(owner))[owner]
        keep, back = np.unique(r, return_inverse=True)
        out.append((keep.astype(np.int32), np.bincount(back, w).astype(np.float32)))
    return out


def gains(found: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """How much each row counts, 0 to 1: by how surely it is more frequent in one class, so that few texts don't teach the noise of rare rows."""
    times = np.zeros((2, BUCKETS))
    for (r, _), k in zip(found, y, strict=True):
        times[k, r] += 1
    n = np.array([[(y == 0).sum()], [(y == 1).sum()]])
    share = (times.sum(0) + 1) / (len(y) + 2)
    error = np.sqrt(share * (1 - share) * (1 / n).sum())
    return np.minimum(np.abs(np.diff(times / n, axis=0)[0]) / error / SURE, 1) ** 2


def fit(sample: Sample, dim: int = 8, epochs: int = 20, batch: int = 256, rate: float = 0.1, ridge: float = 5000.0, seen: int = 3, seed: int = 7) -> Model:
    """Stochastic gradient descent on embeddings and softmax together.

    A row's step is divided by the weight it has over all texts, and by ``ridge`` (in
    texts that hold it once), which holds back rare rows; rows in fewer than ``seen``
    texts stay zero, and the others' vectors are multiplied by their ``gains``. Classes weigh alike, so a score of 0.5 means that a text is as
    likely under either.
    """
    y = np.array([int(v) for v in sample.labels])
    n1, n0 = sample.counts.get(1, 0), sample.counts.get(0, 0)
    prior = n1 / max(1, n1 + n0)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 0.0, prior)
    found = features(sample.texts)
    times = np.zeros(BUCKETS, np.int64)
    for r, _ in found:
        times[r] += 1
    gain = gains(found, y).astype(np.float32)
    used = (times >= seen) & (gain >= LEAST_GAIN)
    if not used.any():  # nothing tells the classes apart
        return Model(np.zeros(BUCKETS), float(np.log(max(n1, 1) / max(n0, 1))), prior)
    found = [(r[used[r]], (w * gain[r])[used[r]] * np.float32(SCALE)) for r, w in found]
    bounds = np.cumsum([0, *(r.size for r, _ in found)])
    rows, weights = (np.concatenate(x) for x in zip(*found, strict=True))
    del found
    rng = np.random.default_rng(seed)
    emb = (rng.normal(0, 0.1, (BUCKETS, dim)) * used[:, None] / SCALE).astype(np.float32)
    soft, bias = rng.normal(0, 1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    energy = np.bincount(rows, weights**2, BUCKETS)
    scale = (rate / (energy + ridge * np.median(weights) ** 2) * len(y)).astype(np.float32)
    share = np.array([0.5 / max(1, (y == k).sum()) for k in (0, 1)], np.float32)[y] * len(y)
    batches, order = [], rng.permutation(len(y))
    for lo in range(0, len(y), batch):  # the same texts meet in every round, so each batch is sorted by row once
        docs = np.sort(order[lo : lo + batch])
        docs = docs[bounds[docs + 1] > bounds[docs]]
        if docs.size:
            take = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in docs])
            r, by_row = rows[take], np.argsort(rows[take], kind="stable").astype(np.int32)
            touched, first = np.unique(r[by_row], return_index=True)
            size = bounds[docs + 1] - bounds[docs]
            batches.append((docs, r, weights[take], np.cumsum(size) - size, np.repeat(np.arange(docs.size, dtype=np.int32), size)[by_row], weights[take][by_row], touched, first))
    del rows, weights
    for epoch in range(epochs):
        decay = 1 - epoch / epochs
        for b in rng.permutation(len(batches)):
            docs, r, w, begins, owner, w_by_row, touched, first = batches[b]
            hidden = np.add.reduceat(emb[r] * w[:, None], begins)
            logits = hidden @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(docs.size), y[docs]] -= 1
            p *= share[docs, None] / docs.size
            back = np.add.reduceat((p @ soft.T)[owner] * w_by_row[:, None], first)
            emb[touched] -= decay * scale[touched, None] * back
            soft -= 0.05 * hidden.T @ p
            bias -= 0.05 * p.sum(0)
    diff = (soft[:, 1] - soft[:, 0]) * SCALE
    return Model((emb @ diff * gain).astype(np.float64), float(bias[1] - bias[0]), prior)


class Scorer:
    """Scores texts with a model; keeps the logit of each word it has met."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.cache: dict[str, float] = {}

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Each text's logit, NaN without words."""
        out = np.empty(len(texts))
        for lo in range(0, len(texts), 256):
            split = [set(words_of(t)) for t in texts[lo : lo + 256]]
            if len(self.cache) > CACHED:
                self.cache.clear()
            if new := list(set().union(*split).difference(self.cache)):
                self.cache.update(zip(new, self.model.word_logits(new).tolist(), strict=True))
            get = self.cache.__getitem__
            out[lo : lo + 256] = [sum(map(get, ws)) / (len(ws) + REST) + self.model.bias if ws else np.nan for ws in split]
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = self.logits(texts)
        return np.where(np.isnan(z), self.model.prior, 1 / (1 + np.exp(-np.clip(z, -50, 50))))


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that its text is toxic in column ``out``, whatever other columns there are."""
    plain, name = by_place(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.value)
        for texts in batches:
            yield pd.Series(scorer.scores(texts.tolist()))
        release()

    return plain.withColumn(out, score(name)).toDF(*docs.columns, out)
