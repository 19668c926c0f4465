"""Token ids of whole texts from remembered ids of their chunks.

A text whose white space is only single spaces and single newlines between words falls into chunks
(a newline; a word; a space and a word) that no match of the pre-tokenizer crosses, so the ids of
the text are the ids of its chunks in order. Any other text is encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable


SEEN_BITS = 1 << 25


class _Known(dict):
    """Packed ids by word; stops learning when full, so the frequent early words stay.

    ``twice``: a word is learned when it comes again, so words that come once take a bit each and no entry.
    """

    def __init__(self, prefix: str, encode: Callable[[str], bytes], most: int, twice: bool):
        super().__init__()
        self.prefix, self.encode, self.most = prefix, encode, most
        self.seen = bytearray(SEEN_BITS // 8) if twice else None

    def __missing__(self, word: str) -> bytes | None:
        # None (no packed ids) sends the whole text to the plain way.
        ids = self.encode(self.prefix + word) if word and word == word.strip() else None
        if len(self) < self.most and len(word) < 64 and (self.seen is None or self._again(word)):
            self[word] = ids
        return ids

    def _again(self, word: str) -> bool:
        """Whether the word, or another one of its bit, was here before."""
        at, bit = divmod(hash(word) % SEEN_BITS, 8)
        known = self.seen[at] >> bit & 1
        self.seen[at] |= 1 << bit
        return bool(known)


class ChunkEncoder:
    """``encode`` maps a string to its ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, encode: Callable[[str], bytes], most: int = 600_000, odd: str = "<|", twice: bool = False):
        self.plain, self.odd = encode, odd
        self.first, self.later, self.newline = _Known("", encode, most // 8, twice), _Known(" ", encode, most, twice), encode("\n")

    def __call__(self, text: str) -> bytes:
        if self.odd in text:
            return self.plain(text)
        parts: list = []
        for line in text.split("\n"):
            words = line.split(" ")
            parts.append(self.newline)
            parts.append(self.first[words[0]])
            parts += map(self.later.__getitem__, words[1:])
        try:
            return b"".join(parts[1:])
        except TypeError:
            return self.plain(text)
