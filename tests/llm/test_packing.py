import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm.packing import combinations, encoder, nnls, pack, plan

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, got):
    tokenizer, pieces, sequences = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted(pieces.pop(i), key=lambda p: p["start"]):
            cut = np.array(ids[p["start"] : p["start"] + p["length"]], dtype="<u4").tobytes()
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(cut)
            at += p["length"]
        assert at == len(ids)
    assert not pieces
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    return len(sequences)


def test_pieces_cover_documents_and_fill_windows(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["the", "of", "Straße", "élan", "x9", "foo,"]) for _ in range(r.choice([3, 40, 300, 900, 2500])))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "  two  spaces \n\n"), (1003, "a <|endoftext|> b"), (1004, "tab\tand\xa0nbsp\r\nline\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pack(df, PATH).collect()
    n = check(rows, got)
    assert sum(p["length"] for p in got) >= 0.97 * 1024 * (n - 1)


def test_empty_table_repeats_and_clashing_names(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    df = spark.createDataFrame([(1, "a b", 5, 6), (1, "a b", 7, 8), (None, "c", 0, 0)], "doc_id long, text string, row int, bin int")
    got = pack(df, PATH).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == ["1", "1", "None"] and sum(r["length"] for r in got) == 8


def test_plan_uses_every_piece_once():
    r = random.Random(3)
    for units in (8, 32, 128):
        h = Counter(r.randrange(1, units + 1) for _ in range(5000))
        used = Counter()
        for pattern, n in plan(h, units):
            assert sum(pattern) <= units and n > 0
            for k in pattern:
                used[k] += n
        assert used == h
    assert plan({}, 8) == []


def test_combinations_and_least_squares():
    assert set(combinations(4, 3)) == {(4,), (3, 1), (2, 2), (2, 1, 1)}
    r = np.random.default_rng(1)
    a, x = r.random((20, 40)), np.maximum(r.normal(size=40), 0)
    b = a @ x
    got = nnls(a, b)
    assert (got >= 0).all() and np.linalg.norm(a @ got - b) < 1e-4
    got = nnls(a, -b)
    assert np.linalg.norm(got) == 0


def test_lengths_that_no_others_complete_are_cut(spark):
    rows = [(i, "the " * n) for i, n in enumerate([600, 601, 650, 700, 590] * 60)]
    n = check(rows, got := pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect())
    tokens = sum(p["length"] for p in got)
    assert n <= -(-tokens // 1024) + 4
    by_doc = Counter(p["doc_id"] for p in got)
    assert max(by_doc.values()) <= 2


def test_words_that_come_once_take_no_memory():
    """Two workers an executor with a million entries each made the pipeline's highest real memory."""
    encode, text = encoder(PATH), "qzxa qzxb qzxc\nqzxd qzxb qzxe\nqzxd qzxb"
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    for _ in range(2):
        encode.later.clear()
        encode.first.clear()
        encode.later.seen[:] = bytes(len(encode.later.seen))
        assert np.frombuffer(encode(text), dtype="<u4").tolist() == want
        assert set(encode.later) == {"qzxb"}
    assert "qzxd" in encode.first
