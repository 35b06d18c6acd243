"""Language identification by a convolutional network over bytes, trained in numpy.

The UTF-8 bytes of a text are cut into windows of fixed length; all windows count.
Filters that see 2, 4 and 6 bytes slide over a window two bytes at a time on learned byte
embeddings; each filter's largest response goes through a linear softmax. A text's
logits are the mean of its windows' logits, weighted by their bytes.

For inference the embeddings and filters are folded into tables with one row for each
pair of bytes, so a filter's response is a sum of looked-up rows.

Texts that are null or have no letter are ``und`` with score 0. If the sample has one
language alone, all other texts get it with score 1; if it has none, they are ``und``.
Repeated rows score alike; texts shorter than a window are padded with zero bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.labelled import Sample
from quern.llm.store import by_place

WINDOW = 256
WIDTHS = (2, 4, 6)
FILTERS = 16
EMBEDDING = 8
UNDETERMINED = "und"
#: Windows convolved at once.
CHUNK = 512


@dataclass
class Model:
    """Languages, one pair table for each offset of each width, filter biases, and the softmax layer."""

    languages: list[str]
    tables: dict[int, list[np.ndarray]]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """Logits of uint8 windows (n, WINDOW)."""
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for lo in range(0, len(windows), CHUNK):
            pairs = np.ascontiguousarray(windows[lo : lo + CHUNK]).view("<u2")
            top = []
            for width in WIDTHS:
                last = pairs.shape[1] - width // 2 + 1
                r = np.take(self.tables[width][0], pairs[:, :last], axis=0)
                for k, t in enumerate(self.tables[width][1:], 1):
                    r += np.take(t, pairs[:, k : k + last], axis=0)
                top.append(r.max(1))
            hidden = np.maximum(np.concatenate(top, 1) + self.bias, 0)
            out[lo : lo + CHUNK] = hidden @ self.weights + self.offset
        return out


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, the text each belongs to, and its bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = -(-sizes // WINDOW)
    out = np.zeros(int(n.sum()) * WINDOW, np.uint8)
    at = 0
    for t, k in zip(texts, n.tolist(), strict=True):
        out[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += k * WINDOW
    owner = np.repeat(np.arange(len(texts)), n)
    first = np.cumsum(n) - n
    held = np.minimum(WINDOW, sizes[owner] - (np.arange(owner.size) - first[owner]) * WINDOW)
    return out.reshape(-1, WINDOW), owner, held


def folded(languages: list[str], emb: np.ndarray, filters: dict[int, np.ndarray], bias: np.ndarray, weights: np.ndarray, offset: np.ndarray) -> Model:
    low, high = np.arange(65536) & 255, np.arange(65536) >> 8
    tables = {w: [(emb[low] @ f[2 * k] + emb[high] @ f[2 * k + 1]).astype(np.float32) for k in range(w // 2)] for w, f in filters.items()}
    return Model(languages, tables, bias, weights, offset)


def fit(sample: Sample, epochs: int = 4, batch: int = 64, rate: float = 0.01, max_windows: int = 12000, seed: int = 5) -> Model:
    """Adam on all layers, over at most ``max_windows`` windows spread over the sampled texts."""
    languages = sorted(set(sample.labels))
    code = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    x, owner, _ = windows_of([t.encode() for t in sample.texts])
    chosen = np.sort(rng.permutation(len(x))[:max_windows])
    x, y = x[chosen], np.array([code[v] for v in sample.labels], int)[owner[chosen]]
    p = {"emb": rng.normal(0, 0.3, (256, EMBEDDING)), "bias": np.zeros(len(WIDTHS) * FILTERS), "weights": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))), "offset": np.zeros(len(languages))}
    p |= {f"f{w}": rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, s, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    share = (len(y) / max(1, len(languages)) / np.maximum(1, np.bincount(y, minlength=len(languages))))[y].astype(np.float32)
    for _ in range(epochs if len(languages) > 1 else 0):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            at = order[lo : lo + batch]
            xb, n = x[at], len(at)
            # some windows are cut short, as short texts are
            cut = rng.integers(1, 5, n) * (WINDOW // 8)
            xb = np.where((rng.random(n) < 0.3)[:, None] & (np.arange(WINDOW) >= cut[:, None]), np.uint8(0), xb)
            e = p["emb"][xb]
            tops, where = [], []
            for w in WIDTHS:
                seen = np.lib.stride_tricks.sliding_window_view(e, w, 1)[:, ::2].transpose(0, 1, 3, 2).reshape(n, -1, w * EMBEDDING)
                r = seen @ p[f"f{w}"]
                best = r.argmax(1)
                where.append((best, np.take_along_axis(seen, best[:, :, None], 1)))
                tops.append(np.take_along_axis(r, best[:, None], 1)[:, 0])
            raw = np.concatenate(tops, 1) + p["bias"]
            hidden = np.maximum(raw, 0)
            z = hidden @ p["weights"] + p["offset"]
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(n), y[at]] -= 1
            q *= share[at, None] / n
            g = {"weights": hidden.T @ q, "offset": q.sum(0)}
            d = (q @ p["weights"].T) * (raw > 0)
            g["bias"], g["emb"] = d.sum(0), np.zeros_like(p["emb"])
            for i, w in enumerate(WIDTHS):
                best, seen = where[i]
                dw = d[:, i * FILTERS : (i + 1) * FILTERS]
                g[f"f{w}"] = np.einsum("nf,nfk->kf", dw, seen)
                back = (dw[:, :, None] * p[f"f{w}"].T[None]).reshape(n, FILTERS, w, EMBEDDING)
                index = xb[np.arange(n)[:, None, None], (2 * best)[:, :, None] + np.arange(w)]
                np.add.at(g["emb"], index, back)
            step += 1
            for k, v in g.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                p[k] -= (rate * m[k] / (1 - 0.9**step) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    filters = {w: p[f"f{w}"].reshape(w, EMBEDDING, FILTERS) for w in WIDTHS}
    return folded(languages, p["emb"], filters, p["bias"], p["weights"], p["offset"])


def predicted(model: Model, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Most likely language and its probability for each (not empty) text."""
    x, owner, held = windows_of(texts)
    z = model.logits(x) * held[:, None]
    total = np.stack([np.bincount(owner, z[:, k], len(texts)) for k in range(z.shape[1])], 1) / np.maximum(1, np.bincount(owner, held, len(texts)))[:, None]
    q = np.exp(total - total.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    best = q.argmax(1)
    return [model.languages[k] for k in best], q[np.arange(len(texts)), best].astype(np.float64)


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with struct column ``language`` (lang_pred, score), whatever other columns there are."""
    plain, name = by_place(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # six tables of 65536 rows

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, letters in batches:
            lang, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            some = np.flatnonzero(letters.to_numpy(bool)) if sent.value.languages else np.zeros(0, int)
            for lo in range(0, some.size, 64):
                at = some[lo : lo + 64]
                lang[at], score[at] = predicted(sent.value, [t.encode() for t in texts.iloc[at]])
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return plain.withColumn("language", predict(name, F.coalesce(F.col(name).rlike(r"\p{L}"), F.lit(False)))).toDF(*docs.columns, "language")
