import random
import re

import numpy as np
import pytest

from tidemark.llm.exact_dedup import exact_dedup, fuse_build, fuse_has

SCHEMA = "doc_id long, text string"


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = []
    for i, t in rows:
        g = groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")]
        out.append((i, min(g)[1], len(g), (-len(t or ""), i) == min(g)))
    return sorted(out)


def texts(seed, n):
    r = random.Random(seed)
    pool = ["", " ", None, "a", "a b", "ab ", "A b", "é\tb", "éb", "\x0bx\x0c", "x", "\xa0x", "hot text"] + [str(r.random()) for _ in range(40)]
    return [r.choice(pool) if r.random() < 0.7 else "hot  text" for _ in range(n)]


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_batches_match_brute_force(spark, digest_bytes):
    rows = list(enumerate(texts(1, 300)))
    old, new = spark.createDataFrame(rows[:120], SCHEMA), spark.createDataFrame(rows[120:], SCHEMA)
    got = exact_dedup(new, old, digest_bytes=digest_bytes).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == brute(rows)


def test_no_snapshot_empty_tables_and_clashing_names(spark):
    rows = [(1, "a", "x"), (1, "a", "y"), (2, "b", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = sorted((r["doc_id"], r["group_size"], r["kept"]) for r in exact_dedup(df).collect())
    assert got == [(1, 2, False), (1, 2, True), (2, 1, True)]  # exactly one row of a group stays
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(empty).count() == 0 and exact_dedup(empty, df).count() == 3 and exact_dedup(df, empty).count() == 3


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5000])
def test_filter_has_all_keys_and_few_others(n):
    r = np.random.default_rng(n)
    keys = r.integers(0, 2**63, n).astype(np.uint64)
    f = fuse_build(keys)
    assert fuse_has(keys, *f).all()
    assert fuse_has(r.integers(0, 2**63, 50_000).astype(np.uint64), *f).mean() < 0.01


def test_long_text(spark):
    long = "word " * 200_000
    got = exact_dedup(spark.createDataFrame([(1, long), (2, long + " "), (3, long + "x")], SCHEMA)).collect()
    assert {r["doc_id"]: r["keep_id"] for r in got} == {1: 2, 2: 2, 3: 3}


def test_exactly_one_row_of_a_group_stays_whatever_its_ids(spark):
    from tidemark.llm.exact_dedup import exact_dedup

    rows = [(1, "a b"), (1, "a b"), (None, "c"), (None, "c"), (None, "d"), (5, "d"), (6, "e  "), (6, "e"), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (32, 1):
        for old in (None, df.limit(0), df.where("doc_id = 1")):
            new = df if old is None or old.isEmpty() else df.where("doc_id is null or doc_id <> 1")
            got = exact_dedup(new, old, digest_bytes=size).collect()
            by = {}
            for r in got:
                by.setdefault(r["text_sha256"], []).append(r)
            assert len(got) == len(rows) and all(sum(r["kept"] for r in g) == 1 and {r["group_size"] for r in g} == {len(g)} for g in by.values())
            assert {(r["doc_id"], r["keep_id"]) for r in got if r["kept"]} == {(1, 1), (None, None), (5, 5), (6, 6)}


@pytest.mark.parametrize("ids", [False, True])
def test_different_texts_that_share_a_digest_all_stay(spark, ids):
    """600 texts in 256 digests, with and without ids, and copies that fill many comparing tasks."""
    rows = [(k if ids else None, f"text {k}") for k in range(600)] + [(k if ids else None, "copy") for k in range(1000, 4000)]
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA), digest_bytes=1).collect()
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    assert len(got) == len(rows) and len(by) == 601 and all(sum(r["kept"] for r in g) == 1 and {r["group_size"] for r in g} == {len(g)} for g in by.values())
