import random
import re

import numpy as np
import pytest

from tidemark.llm.components import components
from tidemark.llm.near_dedup import near_dedup


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    """Components by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), root(i) if i is not None else None, i is None or root(i) == i) for i, s in sets), key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near_dedup(df).collect()), key=str)
    assert got == brute(rows)


def drifting(seed, n, words=60, edits=3):
    """A family in which each text changes a few words of another one, so links form chains."""
    r = random.Random(seed)
    texts = [[f"w{r.randrange(500)}" for _ in range(words)]]
    while len(texts) < n:
        t = list(r.choice(texts[-5:]))
        for _ in range(r.randrange(1, edits)):
            t[r.randrange(len(t))] = f"x{r.randrange(500)}"
        texts.append(t)
    return [" ".join(t) for t in texts]


def test_families_with_chains_match_all_pairs(spark):
    texts = [t for k in range(4) for t in drifting(k, 40)] + drifting(9, 30, 12, 2)
    random.Random(1).shuffle(texts)
    check(spark, [(7 * i, t) for i, t in enumerate(texts)])


def test_shared_passage_of_different_documents(spark):
    r = random.Random(3)
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(i, common + " " + " ".join(f"q{r.randrange(9999)}" for _ in range(r.randrange(5, 60)))) for i in range(60)]
    check(spark, rows)


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one"), (7, "a b c d e"), (8, "a b c d e"), (8, "a b c d e"), (None, "a b c d e"), (10, "É b c d e"), (11, "é b c d e"), (12, " ".join(f"k{i}" for i in range(20_000))), (13, " ".join(f"k{i}" for i in range(19_990)))]
    check(spark, rows)
    check(spark, [])


def test_rows_that_share_an_id_join_their_links(spark):
    rows = [(5, "a b c d e f"), (5, "p q r s t u"), (2, "a b c d e f"), (3, "p q r s t u")]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 2, 2: 2, 3: 2}


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e", 3, "x"), (2, "a b c d e", 4, "y")], "doc_id long, text string, n int, digest string")
    assert [r["component_id"] for r in near_dedup(df).collect()] == [1, 1]


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    r = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 60, (50, 2))] + [(100 + i, 101 + i) for i in range(40)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: i for e in edges for i in e}
    for _ in range(200):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert {k: v for k, v in want.items() if k != v} == got
