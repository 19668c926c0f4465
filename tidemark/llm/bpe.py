"""Byte-level BPE encoding by backtracking, and decoding.

Bytes are mapped to Latin-1 characters, one each, so an Aho-Corasick automaton over the vocabulary
finds the longest token at every byte in one pass. The encoder takes longest matches from left to
right. Two adjacent tokens are compatible if BPE of their joined bytes gives back just these two; the
answers are remembered. Where the next token does not fit the last one, shorter tokens with
the same start are tried, and when none is left the last token is taken back. No place is tried
twice with failure, so the work is linear in the bytes; the result is the exact merge order's.

Tokens that BPE never yields from their own bytes are left out of the automaton, except that a
pre-token which is a vocabulary entry as a whole is that entry. Defined cases: a null text
counts as empty; an empty text has no ids. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.caches import claim, register
from tidemark.llm.chunks import ChunkEncoder


#: Code points that became letters or numbers after Unicode 16, on which the vocabulary's pattern is defined. Fixed values.
LATER_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 "
    "1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 "
    "1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LATER_NUMBERS = (
    "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
)


def _code_points(ranges: str) -> str:
    """The ranges as the inside of a character set."""
    return "".join("-".join(f"\\U{int(end, 16):08X}" for end in r.split("-")) for r in ranges.split())


def of_unicode_16(pattern: str) -> str:
    """``pattern`` with its letters and numbers (``\\p{L}``, ``\\p{N}``) as of Unicode 16, whatever ``regex`` knows."""
    for name, later in (("L", LATER_LETTERS), ("N", LATER_NUMBERS)):
        pattern = pattern.replace(rf"\p{{{name}}}", rf"[\p{{{name}}}--[{_code_points(later)}]]")
    return f"(?V1){pattern}"


def plain_bpe(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids by merging the lowest-ranked adjacent pair until none is in the vocabulary."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, most_pairs: int = 1_000_000):
        import ahocorasick

        self.ranks, self.pattern, self.exact = ranks, regex.compile(pattern), regex.compile(of_unicode_16(pattern))
        self.later = regex.compile(f"[{_code_points(LATER_LETTERS + ' ' + LATER_NUMBERS)}]")
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        own = {t: r for t, r in ranks.items() if plain_bpe(t, ranks) == [r]}
        self.automaton = ahocorasick.Automaton()
        for token, rank in own.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        #: The longest token that a token starts with, itself excepted; -1: none.
        self.shorter = [-1] * len(self.tokens)
        for token, rank in own.items():
            self.shorter[rank] = next((own[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in own), -1)
        self.size = [len(t) for t in self.tokens]
        self.fits: dict[tuple[int, int], bool] = {}
        self.most_pairs = most_pairs
        self.text_ids = ChunkEncoder(self.plain_text)

    @classmethod
    def load(cls, path: str, pattern: str) -> Bpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}, pattern)

    def compatible(self, left: int, right: int) -> bool:
        pair = left, right
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) >= self.most_pairs:
                self.fits.clear()
            known = self.fits[pair] = plain_bpe(self.tokens[left] + self.tokens[right], self.ranks) == [left, right]
        return known

    def piece_ids(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, size = len(piece), self.size
        longest = [-1] * (n + 1)
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - size[rank]
            if longest[start] < 0 or size[rank] > size[longest[start]]:
                longest[start] = rank
        dead, out, at, token = bytearray(n + 1), [], 0, longest[0]
        while at < n:
            while token >= 0 and (dead[at + size[token]] or (out and not self.compatible(out[-1], token))):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at]
            elif out:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return out

    def plain_text(self, text: str) -> bytes:
        ids: list[int] = []
        pattern = self.exact if not text.isascii() and self.later.search(text) else self.pattern
        for piece in pattern.findall(text):
            ids += self.piece_ids(piece.encode("utf-8", "surrogatepass"))
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, packed as little-endian unsigned 32-bit integers."""
        return self.text_ids(text or "")

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_LOADED: dict[tuple[str, str], Bpe] = {}
register("bpe", _LOADED.clear)


def loaded(path: str, pattern: str) -> Bpe:
    """The codec of a vocabulary file, kept by worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe.load(path, pattern)
    return _LOADED[path, pattern]


def encoded(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (binary, little-endian unsigned 32-bit) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe")
        codec = loaded(vocabulary, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.encode(t.as_py()) for t in batch.column(1)], pa.binary())], [id_col, "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` long, ids binary")


def decoded(ids: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``encoded`` with the bytes that their ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe")
        codec = loaded(vocabulary, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([codec.decode(x.as_py()) for x in batch.column(1)], pa.binary())], [id_col, "ids", "decoded"])

    return ids.select(id_col, "ids").mapInArrow(run, f"`{id_col}` long, ids binary, decoded binary")


def digests(rows: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """n_tokens and SHA-256 of ids and of decoded bytes."""
    return rows.select(id_col, F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
