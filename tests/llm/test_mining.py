"""Mixing, collocations and clusters against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import clustering, collocations, mixing
from tests.llm.cases import LONG, ODD, clashing

DOCS = "doc_id long, text string, lang string, source string, TEXT string, size long, at int"


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source) with columns named like the operators' own."""
    return spark.createDataFrame([(*r, "x", 3, 4) for r in rows], DOCS)


# mixing


def plain_targets(sizes):
    """The rule as it is stated: share by weight, cut at twice the size, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = Fraction(3 * sum(sizes.values()), 2), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: Fraction(2 * sizes[s]) for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("seed", range(4))
def test_mixture(spark, seed):
    rng = random.Random(seed)
    names = [None, "b", "a", "é", "Z", "空"][: 3 + seed]
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(int(rng.paretovariate(0.7)) % 700)), "en", rng.choice(names + names[:1] * 4)) for i in range(120)]
    rows += [(i, t, "en", "odd") for i, t in ODD] + [(7, "one two", "en", "b")] * 3 + [(8, None, "en", "empty")]
    out = mixing.mixed(docs(spark, rows), shard_words=500).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in out) == sorted((i is None, i or 0, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _, _ in rows)
    sizes, taken = Counter(), Counter()
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and 0 <= r.taken - r.copies * r.size <= r.size
    wanted, total = plain_targets(sizes), sum(sizes.values())
    block = max(1, min(64, total // 65536))
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(wanted[r.source]))
    shards = Counter((r.source, r.shard) for r in out)
    for s in sizes:  # a full source may lose a part of a block in each shard
        assert abs(taken[s] - wanted[s]) <= 2 * block * (1 + sum(k[0] == s for k in shards))
    assert max(n for (s, _), n in shards.items() if s == "odd") < len(ODD) + 1
    again = mixing.mixed(docs(spark, rows[::-1]).repartition(3), shard_words=500).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))


@pytest.mark.parametrize("seed", range(6))
def test_seats_by_highest_quotients(spark, seed):
    rng = random.Random(seed)
    groups = {g: [rng.choice([0, 1, 1, 5, 30, 1000, rng.randint(1, 10**7)]) for _ in range(rng.randint(1, 30))] for g in range(5)}
    seats = {g: rng.choice([0, 1, 3, 50, 2000]) for g in groups}
    rows = spark.createDataFrame([(g, i, w, seats[g]) for g, ws in groups.items() for i, w in enumerate(ws)], "g int, i int, w long, seats long")
    got = {(r.g, r.i): r.quota for r in mixing.apportioned(rows, ["g"], "w", "seats", "i").collect()}
    for g, ws in groups.items():
        won = Counter()
        for _ in range(seats[g] if sum(ws) else 0):
            won[max((i for i in range(len(ws)) if ws[i]), key=lambda i: (Fraction(ws[i], 2 * won[i] + 1), -i))] += 1
        assert [got[g, i] for i in range(len(ws))] == [won[i] for i in range(len(ws))]


def test_mixture_of_nothing(spark):
    assert mixing.mixed(docs(spark, [])).collect() == []
    assert [(r.size, r.target, r.taken) for r in mixing.mixed(docs(spark, [(1, None, None, None), (2, "", "en", "a")])).collect()] == [(0, 0.0, 0)] * 2
    assert [r.taken for r in mixing.mixed(docs(spark, [(1, "one two three four", "en", "a")])).collect()] == [6]


# collocations


def plain_collocations(rows, least, max_n=4, within=80, first=2000):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for n in range(1, max_n + 1):
                counts[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + k] for q in found for p in [q] for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * found[q] >= within * c[p[i : i + k]]}
        kept = []
        for p, a in found.items():
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            if p not in inside:
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, w.decode(), -a, l, r, total[lang], -s) for i, (s, a, w, l, r) in enumerate(sorted(kept)[:first])]
    return sorted(out)


@pytest.mark.parametrize(("seed", "slice_bytes", "first"), [(0, 1 << 20, 2000), (1, 300, 5), (2, 1, 2000)])
def test_collocations(spark, monkeypatch, seed, slice_bytes, first):
    monkeypatch.setattr(collocations, "SLICE_BYTES", slice_bytes)
    rng = random.Random(seed)
    words = ["La", "la", "DE", "É", "é", "x\xa0y", "\x1fz", "😀", "a'b", "und", *(f"r{i}" for i in range(300))]
    glue = [" ", "  ", "\t", " ", " ", " ", ".", ", ", "\n", "\r\n", ";", "!?"]
    text = lambda: "".join(rng.choice(words[:8] if rng.random() < 0.9 else words) + rng.choice(glue) for _ in range(rng.randint(0, 120)))
    rows = [(i, text(), rng.choice(["en", None, "und", "fr"]), "s") for i in range(60)] + [(9, "la la la la la la", "en", "s")] * 4
    rows += [(i, t, None, None) for i, t in ODD if t != LONG] + [(1, None, None, None)]
    got = collocations.collocations(docs(spark, rows), least=4, first=first).collect()
    assert sorted(tuple(r)[:8] for r in got) == plain_collocations(rows, 4, first=first)
    assert all(r.words == len(r.phrase.split(" ")) for r in got)


def test_longer_phrases_and_long_texts(spark):
    rows = [(1, "one two three four five six. " * 5 + LONG, "en", "s"), (2, "a b c d e f " * 4, "en", "s")]
    got = collocations.collocations(docs(spark, rows), least=4, max_n=6, first=50_000).collect()
    assert sorted(tuple(r)[:8] for r in got) == plain_collocations(rows, 4, max_n=6, first=50_000) and "one two three four five six" in {r.phrase for r in got}
    assert collocations.collocations(docs(spark, rows), least=4, max_n=2).where("words > 2").count() == 0
    assert collocations.collocations(docs(spark, [])).collect() == []


def test_scores_beyond_64_bits(spark):
    big = 2**62
    counts = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big), ("en", 2, "a b", big - 1)], "lang string, n int, phrase string, a long")
    assert collocations.scored(counts.where("n = 2"), counts).collect()[0].score == 2_000_000 * (big - 1) // (2 * big)


# clusters


def plain_clusters(rows, k, rounds, size=64):
    kept = [(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) and abs(x) < 2**19 for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cent = [list(q) for _, q in kept[:k]]
    dist = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c, strict=True))
    near = lambda q: min((dist(q, c), j) for j, c in enumerate(cent))
    for _ in range(rounds):
        at = [near(q)[1] for _, q in kept]
        for j in range(len(cent)):
            if own := [q for (_, q), a in zip(kept, at, strict=True) if a == j]:
                cent[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, *near(q)[::-1]) for i, q in kept]
    sums = Counter()
    for _, c, d in out:
        sums[c] += d
    return sorted(((i is None, i or 0), c, d, sums[c], sum(sums.values()), tuple(cent[c])) for i, c, d in out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id long, embedding array<float>, cluster int, Embedding string, upper double")


def found(df):
    return sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_clusters(spark, monkeypatch, seed):
    monkeypatch.setattr(clustering, "ROWS", 50)
    rng = random.Random(seed)
    grid = lambda: [float(rng.choice([-1, 0, 0, 1]) * 2.0**-8 * rng.choice([1, 3])) for _ in range(4)] + [0.0] * 60  # noqa: E731  many ties
    rows = [(i, grid() if seed else [rng.gauss(0, 0.3) for _ in range(64)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(80)] + [(5, rows[7][1]), (None, rows[3][1]), (None, rows[4][1])]
    rows += [(300, None), (301, [1.0] * 63), (302, [1.0] * 63 + [None]), (303, [1.0] * 63 + [float("nan")]), (304, [float("-inf")] * 64), (305, []), (306, [3e38] * 64), (307, [500000.0] * 64)]
    assert found(clustering.clustered(vectors(spark, rows), k=12)) == plain_clusters(rows, 12, 5)


def test_few_or_no_vectors(spark):
    rows = [(i, [i / 7] * 64) for i in range(3)]
    assert found(clustering.clustered(vectors(spark, rows))) == plain_clusters(rows, 40, 5)
    assert clustering.clustered(vectors(spark, [])).collect() == [] and clustering.clustered(vectors(spark, [(1, None)])).columns[0] == "vec_id"


def test_bounds_skip_distances():
    rng = np.random.default_rng(0)
    centers = rng.integers(-2000, 2000, (20, 64))
    q = (centers[rng.integers(0, 20, 1000)] + rng.integers(-50, 50, (1000, 64))).astype(np.int64)
    cent = q[:20].copy()
    lower = np.zeros((1000, 20), np.float32)
    cluster, upper, own, first = clustering.assign(q, np.zeros(1000, np.int64), np.full(1000, np.inf, np.float32), lower, cent, clustering.between(cent))
    again = clustering.assign(q, cluster, upper, lower, cent, clustering.between(cent))
    assert (again[0] == cluster).all() and (again[2] == own).all() and again[3] < first < 1000 * 21
    d = ((q[:, None] - cent[None]) ** 2).sum(2)
    assert (d.argmin(1) == cluster).all() and (d.min(1) == own).all() and (lower.astype(float) <= np.sqrt(d)).all() and (upper.astype(float) >= np.sqrt(own)).all()


def test_means_go_down(spark):
    state = spark.createDataFrame([([-1, 2], 0), ([-2, 3], 0), ([5, 5], 2)], "q array<int>, cluster int")
    assert clustering.means(state, np.array([[9, 9], [7, 7], [0, 0]])).tolist() == [[-2, 2], [7, 7], [5, 5]]
    assert clustering.whole_numbers(spark.createDataFrame([(1, [-0.001, 0.999])], "vec_id long, embedding array<float>"), 2, 256).select(F.col("q")).first().q == [-1, 255]


def test_names_do_not_clash(spark):
    assert clashing(spark, ODD).count() == mixing.mixed(clashing(spark, ODD)).count()
    assert collocations.collocations(clashing(spark, ODD), least=2).where("phrase = 'one two'").count() == 0
