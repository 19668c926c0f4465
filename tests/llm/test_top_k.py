import math
import random
from collections import Counter

import numpy as np

from tidemark.llm import top_k as tk

SCHEMA = "vec_id long, embedding array<double>, data string, own int"
LIMIT = 2**63 - 1


def brute(rows, asked, k):
    def integers(x):
        if x is None or any(v is None or not math.isfinite(256 * v) for v in x):
            return None
        return [math.floor(256 * v) for v in x]

    known = [(n, i, v) for n, (i, x, *_) in enumerate(rows) if i is not None and (v := integers(x)) is not None]
    out = Counter()
    for n, i, v in known:
        if asked(i):
            scores = sorted((-max(-LIMIT - 1, min(LIMIT, sum(a * b for a, b in zip(v, w)))), j) for m, j, w in known if m != n)
            out.update((i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1))
    return out


def found(spark, rows, k=5, every=50):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return Counter(map(tuple, tk.top_k(df, df.where(f"vec_id % {every} = 0"), k).collect()))


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(tk, "SHARD", 100)
    monkeypatch.setattr(tk, "BLOCK", 16)
    monkeypatch.setattr(tk, "HEAD", 20)
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 24))
    rows = [(int(i), (centres[i % 6] * r.uniform(0.01, 3) + r.normal(size=24) * 0.2).tolist()) for i in range(700)]
    rows += [(int(i), [1.0] * 24) for i in range(700, 1000)]  # copies
    rows += [(1000, [0.0] * 24), (1050, [-0.001] * 24), (1100, []), (1150, [2.0, 1.0])]  # nothing, just below nothing, short ones
    rows += [(-50, rows[3][1]), (0, rows[9][1]), (0, rows[0][1]), (0, rows[0][1]), (750, [1.0] * 24)]  # shared ids, repeated rows
    rows += [(2000, None), (2050, [None] * 24), (2100, [float("nan")] * 24), (2150, [float("inf")] + [0.0] * 23), (None, [1.0] * 24)]
    rows += [(3000 + i, [0.1 * (i % 4), -0.1]) for i in range(40)]  # ties
    random.Random(1).shuffle(rows)
    assert found(spark, rows) == brute(rows, lambda i: i % 50 == 0, 5)


def test_huge_components_and_few_rows(spark):
    rows = [(0, [1e9, 1.0]), (50, [-1e9, 3.0]), (1, [1e300, 0.0]), (2, [1e12, 1e12]), (100, [1e308, 1.0]), (150, [3e15, 7.0]), (3, [3e15, 8.0])]
    assert found(spark, rows) == brute(rows, lambda i: i % 50 == 0, 5)
    assert found(spark, rows[:1]) == Counter() and found(spark, rows[:0]) == Counter() and found(spark, rows[:2]) == brute(rows[:2], lambda i: True, 5)
    assert found(spark, [(0, []), (50, []), (7, [])]) == Counter({(0, 1, 7, 0): 1, (0, 2, 50, 0): 1, (50, 1, 0, 0): 1, (50, 2, 7, 0): 1})
    assert found(spark, [(1, [1.0]), (2, [1.0])]) == Counter()


def test_bounds_pass_over_most_pairs():
    r = np.random.default_rng(2)
    centres = r.normal(size=(10, 64))
    rows = np.floor(256 * np.stack([centres[i % 10] * r.uniform(0.2, 2) + 0.1 * r.normal(size=64) for i in range(4000)]))
    norms = np.sqrt((rows**2).sum(axis=1))
    order = np.argsort(-norms)
    rows, norms = rows[order], norms[order]
    ids = np.arange(len(rows))
    search = tk.Search(ids[::50], rows[::50], np.full(80, tk.LEAST), tk._directions(rows), 5)
    fed = [search.feed(ids[at : at + 100], np.ones(100, bool), rows[at : at + 100], norms[at]) for at in range(0, 4000, 100)]
    scores = (rows[::50] @ rows.T).astype(np.int64)
    for n in range(80):
        want = sorted((-s, i) for i, s in enumerate(scores[n]) if i != n * 50)[:5]
        assert [(-s, i) for q, s, i in zip(search.q, search.s, search.i, strict=True) if q == n] == want
    assert search.summed < 0.1 * 80 * 4000 and not fed[-1] and fed[0]
