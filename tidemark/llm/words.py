"""Words and word shingles of whole texts, as 64-bit hashes, inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from tidemark.llm.caches import register

SHINGLE = 5
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class WordHashes(dict):
    """Hash of a word, remembered; forgets all when it holds ``most`` words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = WordHashes()
register("words", HASHES.clear)


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(text: str | None) -> np.ndarray:
    words = lower_words(text)
    return np.fromiter(map(HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of each run of k words, in order; of the whole sequence if there are fewer."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        h = np.array([n], dtype=np.uint64)
        for w in words:
            h = mix(h * _M[0] + w)
        return h
    h = words[: n - k + 1] * _M[0]
    for i in range(1, k):
        h = h + words[i : n - k + 1 + i] * _M[i % 5]
        h = h ^ (h >> np.uint64(29))
    return mix(h)


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    return np.unique(shingle_hashes(word_hashes(text)))
