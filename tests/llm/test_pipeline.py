import re
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm.words import word_hashes

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
W = r"[^\x20\x09-\x0D]+"


def exact_brute(docs):
    best = {}
    for i, t in docs.items():
        k = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[k] = min(best.get(k, (0, i)), (-len(t), i))
    return {i: docs[i] for _, i in best.values()}


def near_brute(docs):
    sets = {}
    for i, t in docs.items():
        w = re.findall(W, re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: docs[i] for i in ids if find(i) == i}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, SF), "test")
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns and docs.count() == len(got)
        if name == "language ID":
            want = {i: t for i, t in kept.items() if any(c.isalpha() for c in t)}
            assert set(got) <= set(want) and len(got) >= len(want) - 2
        elif name == "exact dedup":
            assert got == exact_brute(kept)
        elif name == "MinHash near-dedup":
            assert got == near_brute(kept)
        else:
            seen = defaultdict(set)
            for i, t in sorted(got.items()):
                h = word_hashes(t)
                for k in range(len(h) - 59):
                    seen[h[k : k + 60].tobytes()].add(i)
            # A run of 60 words in two documents would have been cut, but for ones that cutting itself made.
            assert all(len(ids) == 1 for ids in seen.values())
            assert sum(map(len, got.values())) >= 0.6 * sum(map(len, kept.values()))
        kept = got
    pieces = corpus_pipeline.packed(spark, docs, SF).collect()
    tokens = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert {r["doc_id"]: r["doc_tokens"] for r in pieces} == {i: len(tokens.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    assert np.sum([r["length"] for r in pieces]) == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
        assert docs.count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    r = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{i}" for i in r.integers(0, 10**6, n))
    a, b, c, d, e = (text(40) for _ in range(5))
    rows = [(1, a), (1, a), (2, a), (3, b), (3, c), (4, c), (None, d), (None, d), (5, d), (None, e), (None, e + " "), (6, e)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [tuple(x) for x in corpus_pipeline.exact(spark, docs, SF).collect()]
    assert sorted(out, key=str) == sorted([(1, a), (3, b), (3, c), (5, d), (None, e + " ")], key=str)

    near = [(1, a), (1, a), (2, a + " x"), (3, b), (3, c), (4, c + " x"), (None, d), (None, d + " x"), (None, e)]
    out = [tuple(x) for x in corpus_pipeline.near(spark, spark.createDataFrame(near, "doc_id long, text string"), SF).collect()]
    texts = [t for _, t in out]
    assert len(out) == 5 and (1, a) in out and b in texts and e in texts
    assert sum(t in (c, c + " x") for t in texts) == 1 and sum(t in (d, d + " x") for t in texts) == 1


def test_clashing_columns_and_a_very_long_text(spark):
    extra = ["_id", "_key", "_sha", "_row", "_low", "_doc", "_spans", "lang_pred", "score", "h", "id", "_0"]
    words = lambda a, b: " ".join(f"die{k}" for k in range(a, b))
    rows = [(1, words(0, 60_000), "de", 1), (2, words(0, 60_000), "de", 2), (3, words(50_000, 50_080) + " " + words(70_000, 70_050), "de", 3), (4, words(90_000, 90_040), "de", 4), (5, None, "de", 5), (6, "123", None, 6)]
    schema = "doc_id long, text string, lang string, n_chars int, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame([(*r, *(f"{c} {r[0]}" for c in extra)) for r in rows], schema)
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, SF), "clash")
        assert docs.columns == ["doc_id", "text", "lang", "n_chars", *extra]
    got = {r["doc_id"]: r for r in docs.collect()}
    assert set(got) == {1, 3, 4} and all(r["_key"] == f"_key {i}" and r["score"] == f"score {i}" for i, r in got.items())
    assert got[1]["text"] == rows[0][1] and got[3]["text"] == words(70_000, 70_050)
    assert {r["doc_id"] for r in corpus_pipeline.packed(spark, docs, SF).collect()} == {1, 3, 4}


def test_texts_are_cut_once(spark):
    """A second Python worker a core would stay, and remember words, in all later stages."""
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    cut = corpus_pipeline.substrings(spark, docs, "")
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert [r["text"] for r in cut.collect()] == ["a b"]
