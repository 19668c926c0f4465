import hashlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.bpe import Bpe, decoded, digests, encoded, plain_bpe

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")
CODEC = Bpe.load(PATH, P.PATTERN)
EXACT = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})
WORDS = ["the", "hello", "antidisestablishmentarianism", "é", "ß", "中文", "😀", "'s", "don't", "1234567", "  ", "\n", "\t", "\xa0", "<|endoftext|>", "%%%", "aaaaaaaaaa", "\x1c", " "]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from([*WORDS, " "]), max_size=30).map("".join), st.lists(st.sampled_from(WORDS), max_size=30).map(" ".join)))
def test_ids_are_those_of_the_exact_merges(text):
    ids = CODEC.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == EXACT.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", max_size=40), st.lists(st.text(alphabet="abc", min_size=2, max_size=4), max_size=12, unique=True))
def test_backtracking_on_odd_vocabularies(text, merges):
    ranks = {bytes([c]): c for c in range(256)}
    for m in merges:
        if len(plain_bpe(m.encode(), ranks)) == 2:  # a merge of two tokens, as trained ones are
            ranks[m.encode()] = len(ranks)
    codec = Bpe(ranks, r"\S+|\s+")
    assert codec.piece_ids(text.encode()) == plain_bpe(text.encode(), ranks)


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b\nc"), (3, "a b\nc"), (None, "é" * 50_000), (5, "x " * 40_000)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, ids string")
    got = digests(decoded(encoded(df, PATH, P.PATTERN), PATH, P.PATTERN)).collect()
    want = []
    for i, t in rows:
        ids = EXACT.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert digests(decoded(encoded(df.limit(0), PATH, P.PATTERN), PATH, P.PATTERN)).count() == 0


def test_every_code_point_falls_into_the_same_pieces():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = "".join(f"a{c}a" for c in points[at : at + 4096])
        assert np.frombuffer(CODEC.plain_text(text), "<u4").tolist() == EXACT.encode_ordinary(text)
