import random

import numpy as np
import pytest

from tidemark.llm.substring_dedup import chains, cut_passages, minimizers, outdone, passages_of, repeated_passages, segments, sure_pieces


def words(r, n, tag="w"):
    return [f"{tag}{r.randrange(10**6)}" for _ in range(n)]


def found(spark, rows, **kw):
    return [r.asDict() for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect()]


def edited(r, passage, every):
    out = []
    for i, w in enumerate(passage):
        if i and i % every == 0:
            kind = r.randrange(3)
            out += [[], [w, "new"], ["other"]][kind]
        else:
            out.append(w)
    return out


def brute_runs(a, b, least):
    """Positions of b inside a run of at least `least` words that a has too."""
    hit, run = set(), np.zeros(len(b) + 1, dtype=int)
    for x in a:
        new = np.zeros_like(run)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = run[j] + 1
                if new[j + 1] >= least:
                    hit.update(range(j + 1 - new[j + 1], j + 1))
        run = new
    return hit


def test_exact_runs_are_covered_and_nothing_else(spark):
    r = random.Random(5)
    pool = [words(r, 70) for _ in range(4)] + [words(r, 52) for _ in range(3)]
    texts = []
    for _ in range(25):
        parts = [words(r, r.randrange(0, 120))]
        for p in r.sample(pool, r.randrange(0, 3)):
            parts += [p, words(r, r.randrange(20, 60))]
        texts.append(sum(parts, []))
    got = found(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])
    for j, b in enumerate(texts):
        want = set().union(*(brute_runs(a, b, 51) for a in texts[:j]))
        have = {k for g in got if g["doc"] == j for k in range(g["start"], g["end"])}
        assert want <= have and len(have - want) <= 0.02 * len(b) + 4


def test_fuzzy_passages_are_found(spark):
    r = random.Random(6)
    rows, planted = [], set()
    for k in range(10):
        passage = words(r, 120)
        for copy in range(3):
            body = passage if not copy else edited(r, passage, 25)
            rows.append((10 * k + copy, " ".join(words(r, 80) + body + words(r, 80))))
            if copy:
                planted.add(10 * k + copy)
    rows += [(1000 + i, " ".join(words(r, 150))) for i in range(20)]
    got = found(spark, rows)
    assert {g["doc"] for g in got} == planted
    for g in got:
        assert g["source"] // 10 == g["doc"] // 10 and 90 <= g["end"] - g["start"] <= 140 and 0.75 * 120 < g["matches"] <= 140


def test_cases(spark):
    r = random.Random(7)
    long = words(r, 30_000)
    same = " ".join(words(r, 60))
    rows = [(1, None), (2, ""), (3, "a b"), (4, "x " * 300), (5, "x " * 300), (6, " ".join(long)), (7, " ".join(long[:20_000])), (8, same), (9, same), (9, same), (None, same)]
    got = found(spark, rows)
    by = {(g["doc"], g["source"]): (g["start"], g["end"]) for g in got}
    assert by[7, 6] == (0, 20_000) and by[9, 8] == (0, 60) and {d for d, _ in by} <= {5, 7, 9}
    assert found(spark, []) == []


def test_cutting(spark):
    df = spark.createDataFrame([(1, "A b\n c  d e", "k", 1), (2, "a b c", "m", 2), (3, None, "n", 3), (4, "x y z", "o", 4)], "doc_id long, text string, end string, start int")
    spans = spark.createDataFrame([(1, 1, 3), (1, 2, 4), (2, 0, 3), (4, 0, 1), (4, 1, 2)], "doc long, start long, end long")
    got = {r["doc_id"]: r["text"] for r in cut_passages(df, spans).collect()}
    assert got == {1: "A b\n e".replace("b\n ", ""), 2: "", 3: None, 4: "z"}
    assert cut_passages(df, spans).columns == df.columns


def test_minimizers_cover_every_window():
    h = np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64)
    at = minimizers(h)
    assert np.diff(np.concatenate([[-1], at, [1000]])).max() <= 16 and len(at) < 200
    assert minimizers(np.full(500, 7, dtype=np.uint64)).tolist() == [0]


def test_chains_follow_the_best_path():
    x = np.array([0, 10, 20, 500, 30, 40]), np.array([0, 10, 20, 25, 32, 42])
    seg = segments(*x)
    best = chains(seg)[0]
    assert 500 not in seg[best][:, 0]


def template_pair(r, shared, unlike):
    """Two texts of equal length, with the spans of what they share."""
    a, b, spans = words(r, 30), words(r, 30), []
    for i, n in enumerate(shared):
        if i:
            a, b = a + words(r, unlike), b + words(r, unlike)
        same = words(r, n)
        spans.append((len(b), len(b) + n))
        a, b = a + same, b + same
    return a + words(r, 30), b + words(r, 30), spans


def test_passages_of_one_template_are_not_lost(spark):
    r = random.Random(8)
    rows, want = [], {}
    for k, (shared, unlike) in enumerate([((52, 52), 40), ((55, 55), 40), ((55, 55, 55), 35), ((60, 60, 60, 60), 40), ((30, 30), 15)] * 8):
        a, b, spans = template_pair(r, shared, unlike)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        want[2 * k + 1] = spans if min(shared) >= 50 else [(spans[0][0], spans[-1][1])]
    got = found(spark, rows)
    assert {d: sorted((g["start"], g["end"]) for g in got if g["doc"] == d) for d in want} == want


def test_short_pieces_join_only_where_they_are_alike():
    def of(*runs):
        hub = np.concatenate([np.arange(n) + 1000 * i for i, n in enumerate(runs)]).astype(np.uint32)
        doc = np.concatenate([np.arange(n) + 1000 * i + (500_000 if i % 2 else 0) for i, n in enumerate(runs)]).astype(np.uint32)
        return passages_of(hub, doc, np.array([[0, len(hub) - 5, 0, len(hub) - 5]]), 50, 0.75)

    assert of(30, 15, 30) == [(0, 75, 0, 75, 60)] and of(30, 30, 30) == []
    assert of(52, 40, 52) == [(0, 52, 0, 52, 52), (92, 144, 92, 144, 52)]
    assert of(60, 10, 1, 40, 60) == [(0, 60, 0, 60, 60), (111, 171, 111, 171, 60)]


def test_passages_whose_halves_are_in_earlier_documents_are_found(spark):
    r = random.Random(10)
    rows, want = [], set()
    for k in range(40):
        n = (60, 90)[k % 2]
        p = words(r, n)
        for i, body in enumerate((p[: n // 2], p[n // 2 :], p, p[: n // 2], p[n // 2 :], p)):
            rows.append((10 * k + i, " ".join(words(r, 60) + body + words(r, 60))))
        want.add((10 * k + 5, 10 * k + 2, 60, 60 + n))
    got = {(g["doc"], g["source"], g["start"], g["end"]) for g in found(spark, rows)}
    assert got == want


def test_passages_with_a_fifth_of_their_words_replaced_are_found(spark):
    r = random.Random(9)
    rows = []
    for k in range(60):
        passage = words(r, 60)
        copy = list(passage)
        for i in r.sample(range(1, 59), 12):
            copy[i] = words(r, 1)[0]
        rows += [(2 * k, " ".join(words(r, 60) + passage + words(r, 60))), (2 * k + 1, " ".join(words(r, 60) + copy + words(r, 60)))]
    got = found(spark, rows)
    assert all(g["source"] == g["doc"] - 1 and g["end"] - g["start"] >= 50 for g in got)
    assert len({g["doc"] for g in got}) >= 50


def test_equal_runs_with_replaced_words_between_are_all_found(spark):
    r = random.Random(11)
    rows, want = [], {}
    for k, (run, gap) in enumerate([(60, 20), (60, 30), (80, 40), (100, 45), (60, 60)]):
        a, b, spans = template_pair(r, (run,) * 10, gap)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        want[2 * k + 1] = {i for lo, hi in spans for i in range(lo, hi)}
    got = found(spark, rows)
    for doc, words_ in want.items():
        assert words_ <= {i for g in got if g["doc"] == doc for i in range(g["start"], g["end"])}


def test_scattered_seeds_and_every_sixth_word_changed(spark):
    r = random.Random(12)
    rows, want = [], {}
    for k in range(20):
        p, base = words(r, 120), 100 * k
        for i in range(6):  # earlier documents have twenty words each
            rows.append((base + i, " ".join(words(r, 40) + p[20 * i : 20 * i + 20] + words(r, 40))))
        rows += [(base + 10 + i, " ".join(words(r, 40) + p + words(r, 40))) for i in range(2)]
        want[base + 11] = base + 10
    for k in range(40):
        p = words(r, 60)
        q = [w if i % 6 != 3 else words(r, 1)[0] for i, w in enumerate(p)]
        rows += [(5000 + 2 * k, " ".join(words(r, 40) + p + words(r, 40))), (5001 + 2 * k, " ".join(words(r, 40) + q + words(r, 40)))]
        want[5001 + 2 * k] = 5000 + 2 * k
    got = {(g["doc"], g["source"]) for g in found(spark, rows)}
    hit = [d for d, s in want.items() if (d, s) in got]
    assert sum(d < 5000 for d in hit) >= 18 and sum(d > 5000 for d in hit) >= 36


def test_many_runs_in_one_pair_and_crowds(spark):
    r = random.Random(13)
    a, b = [], []
    for i in range(1500):
        same = words(r, 30)
        a += same + words(r, 20)
        b += same + words(r, 19 + i % 2)
    got = found(spark, [(1, " ".join(a)), (2, " ".join(b))])
    assert all(g["doc"] == 2 for g in got)
    hot = words(r, 70)
    crowd = [(i, " ".join(words(r, 30) + hot + words(r, 30))) for i in range(300)]
    got = found(spark, crowd)
    assert {g["doc"] for g in got} == set(range(1, 300)) and len(got) <= 600
    assert {g["doc"] for g in got if g["start"] <= 30 and g["end"] >= 100} == set(range(1, 300))
    assert all(g["source"] < g["doc"] for g in got)


def test_sure_pieces_outdo_what_lies_inside():
    y = np.concatenate([np.arange(0, 100, 3), np.arange(10, 40, 3)])
    m = np.stack([np.full(len(y), 9), np.repeat([1, 2], [34, 10]), y, y + 7])
    assert [c.tolist() for c in sure_pieces(m, 50, 0.75)] == [[9], [1], [0], [104]]
    assert outdone([(0, 104, 1), (10, 42, 2), (90, 110, 3), (0, 104, 2)], [(0, 104, 1)]) == [False, True, False, True]


def test_periodic_texts_are_whole_and_cheap(spark):
    r = random.Random(15)
    rows = [(k, " ".join(words(r, 40) + ["tick", "tock"] * n + words(r, 40))) for k, n in enumerate((200, 250, 100))]
    rows += [(10 + k, "x " * 300) for k in range(2)]
    got = found(spark, rows)
    assert len(got) <= 12
    for doc, lo, hi in ((1, 40, 540), (2, 40, 240), (11, 0, 300)):
        assert set(range(lo, hi)) <= {i for g in got if g["doc"] == doc for i in range(g["start"], g["end"])}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def changed(r, passage, kinds, share):
    out = []
    for w in passage:
        kind = r.choice(kinds) if r.random() < share else "keep"
        out += {"keep": [w], "delete": [], "insert": [w, *words(r, 1, "i")], "replace": words(r, 1, "r")}[kind]
    return out


@pytest.mark.parametrize("kinds", [["insert"], ["delete"], ["replace"], ["insert", "delete", "replace"]])
def test_recall_of_passages_with_edits(spark, kinds):
    """Planted in one corpus: at least nine of ten of those that are alike enough, by their longest common subsequence."""
    r = random.Random(str(kinds))
    rows, planted = [], {}
    for k in range(120):
        p = words(r, (60, 90, 130, 200)[k % 4])
        q = changed(r, p, kinds, (0.05, 0.1, 0.15)[k % 3])
        if len(q) > 51 and lcs(p, q) >= 0.75 * max(len(p), len(q)):
            planted[2 * k + 1] = (2 * k, len(q))
        rows += [(2 * k, " ".join(words(r, 70) + p + words(r, 70))), (2 * k + 1, " ".join(words(r, 70) + q + words(r, 70)))]
    got = found(spark, rows)
    assert all(g["source"] == g["doc"] - 1 for g in got)
    whole = 0
    for doc, (_, n) in planted.items():
        have = {k for g in got if g["doc"] == doc for k in range(g["start"], g["end"])}
        whole += len(have & set(range(70, 70 + n))) >= 0.9 * n
        assert len(have - set(range(70, 70 + n))) <= 12
    assert len(planted) > 80 and whole >= 0.9 * len(planted), (whole, len(planted))


def test_passages_with_every_eighth_word_gone_or_new(spark):
    r = random.Random(12)
    rows = []
    for k in range(40):
        p = words(r, (120, 200)[k % 2])
        q = [x for i, w in enumerate(p) for x in ([] if i % 8 == 7 and k % 4 < 2 else [w, f"n{k}{i}"] if i % 8 == 7 else [w])]
        rows += [(2 * k, " ".join(words(r, 50) + p + words(r, 50))), (2 * k + 1, " ".join(words(r, 50) + q + words(r, 50)))]
    got = found(spark, rows)
    lengths = {k: len(rows[k][1].split()) - 100 for k in range(1, 80, 2)}
    whole = [d for d, n in lengths.items() if any(g["doc"] == d and g["end"] - g["start"] >= 0.9 * n for g in got)]
    assert len(whole) >= 38
