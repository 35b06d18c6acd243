import random
from collections import Counter

import numpy as np
import pytest

from quern.llm import near_dedup as nd
from tests.llm.cases import ODD, clashing


def brute(rows, n):
    """doc_id -> (set size, least id of its component), by comparing all pairs."""
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = []
    for i, t in rows:
        w = (t or "").encode().translate(low).split()
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(s), least.get(root(k), i) if s else i) for k, (i, s) in enumerate(sets)), key=repr)


def found(df, n):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nd.near_duplicates(df, n).collect()), key=repr)


def corpus(seed=3):
    """Families of near copies, chains, copies, a passage that many share, and texts of their own."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    out = []
    for size, edits in ((40, 2), (25, 6), (3, 1), (2, 9)):
        base = [word() for _ in range(120)]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
    chain = [word() for _ in range(100)]
    for k in range(15):
        chain = [*chain[:-6], *[word() for _ in range(6)]] if k else chain
        out.append(" ".join(chain))
    out += [" ".join([*passage, *[word() for _ in range(r.randint(5, 60))]]) for _ in range(60)]
    out += [" ".join(word() for _ in range(r.randint(1, 80))) for _ in range(40)]
    out += [out[0]] * 5
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("n", [4, 5])
def test_components_are_exact(spark, monkeypatch, n):
    monkeypatch.setattr(nd, "SHORT", 3)  # long lists, pivots and blocks all take part
    monkeypatch.setattr(nd, "BLOCK", 16)
    rows = corpus()
    assert found(clashing(spark, rows), n) == brute(rows, n)


def test_odd_rows(spark):
    assert found(clashing(spark, ODD), 4) == brute(ODD, 4)
    assert nd.near_duplicates(clashing(spark, []), 4).collect() == []


def test_thresholds_between_percents(spark):
    """4 of 5, 5 of 6 and 6 of 7 shingles in common, at thresholds on and beside these."""
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, "p q r s t u v w"), (4, "p q r s t u v w x"), (5, "i j k l m n o h y z"), (6, "i j k l m n o h y")]
    for threshold, linked in ((0.79, 3), (0.8, 3), (0.805, 2), (0.83, 2), (0.84, 1), (0.86, 0)):
        got = nd.near_duplicates(clashing(spark, rows), 4, threshold).collect()
        assert sum(not r.kept for r in got) == linked, threshold


def test_one_of_each_keeps_columns(spark):
    df = clashing(spark, ODD)
    kept = nd.one_of_each(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 6, None, 7, 8])


def test_one_of_each_decides_by_row(spark):
    """Null ids and an id with two texts: each row for itself."""
    a, b, c = "a one two three four five six", "b one two other words stand here", "c nothing like the ones before it"
    rows = [(None, a), (None, a), (None, b), (1, b), (2, b), (2, c), (3, c)]
    kept = nd.one_of_each(clashing(spark, rows)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(None, a), (1, b), (2, c)])


def test_union_sketch_counts():
    r = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 60, 30).astype(np.uint64)) for _ in range(2))
        union = np.union1d(a, b)[:20]
        assert nd.in_union_sketch(a[:20], b[:20], 20) == (len(set(a) & set(b) & set(union)), len(union))


def test_bound_on_shared_entries():
    assert nd.shared_at_least(64, 0.8) < 64 * 0.8 and nd.shared_at_least(64, 1.0) == 64
    hits = np.random.default_rng(2).binomial(64, 0.8, 1_000_000)
    assert (hits >= nd.shared_at_least(64, 0.8)).all()


def test_components_alone(spark):
    from quern.llm.components import connected_components

    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {x.u: x.v for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
