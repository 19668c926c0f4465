"""Fuzzy passages that repeat across documents, by collinear chaining.

1. Seeds: of the 5-word shingles of a document, the minimum of every window of 4 (minimizers), so
   every common run of 8 words shares a seed at the same relative place. One shared seed is enough
   for an alignment. Runs of 35 words that start at a minimizer of 16 are seeds too; every common run
   of 50 words has one.
2. Each occurrence of a seed is tied to the first document that has it, the hub, and to the last
   document before its own, as one anchor (hub, doc, hub position, position) each; a seed with m of
   them makes less than 2m anchors and not m^2. A seed carries two bits of each of the eight words on
   either side; an anchor says whether these agree.
   Tasks pack their seeds in blocks by bucket of the hash. A seed that more than ``CROWD`` documents
   of a block share is tied inside the block, and only its first and last occurrence there go on, so
   no frequent seed gathers in one task.
3. Anchors of a (doc, hub) pair are merged along diagonals and chained with a linear gap cost; the
   best predecessor comes from a Fenwick tree of prefix maxima over hub positions. A chain of a single
   anchor counts only where the words beside it agree; inserted and deleted words shift those, but leave
   other anchors near. Of equally good predecessors and chains the later found. Where anchors alone
   prove a passage, chains of other sources inside it are left out: they add no words to it.
4. Chains are aligned on the words of both texts: matches along the diagonals, the best switch point
   in gaps where the diagonal moves, and extension at both ends. In what stays unequal between two
   places, and beyond the ends, runs of three words of a longest common subsequence count too. The aligned words are cut at the
   longest unlike stretch until every piece is alike, inside a diagonal too; pieces too short alone
   join a neighbour where both are alike together. A passage is reported from ``min_words`` words and
   ``similarity`` on.

Defined cases: null, blank and short texts have no passages. Repeats inside one document are not
reported. Ids should be unique; rows that share an id count as one document. Rows without an id are
skipped. Columns other than id and text are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.caches import claim
from tidemark.llm.names import free
from tidemark.llm.words import SHINGLE, mix, shingle_hashes, word_hashes
from tidemark.plans.staging import stage

WINDOW = 16
DENSE = 4  # window of the seeds
MARGIN = 48  # words beyond a chain that its alignment may reach
GRID = 32  # hub spans start and end at multiples, so many chains ask for one span
GAP = 0.08  # per word that a gap spans, on each side
MERGE = 64
SHORT = 24  # words of a chain
MOST_SHIFT = 16  # words inserted or deleted between two anchors that support each other
LONG = 35  # words; WINDOW + LONG - 1 = 50
MOST_LOST = 12  # unequal words in a row beyond which two passages are reported instead of one
MIN_WORDS = 50
CONTEXT = 8  # words on each side of a seed of which two bits are known
ONE_SIDE, BOTH_SIDES = 6, 9  # of them equal, so that a seed is an anchor
GAP_WORDS = WINDOW + SHINGLE + CONTEXT  # nothing reaches from one text to the next
CHUNK_WORDS = 100_000  # whose seeds are looked for at once
RUN = 3  # equal words in a row that count in a stretch with inserted or deleted words
LEAST_RUNS = 0.24  # of them for each word of the shortest passage; with every fifth word changed 0.4 are left
HOLE = 10_000  # places of such a stretch, one text's words times the other's
BLOCK = 1 << 19  # seeds that a task holds at once
CROWD = 16  # documents of a block that share a seed, beyond which it is tied inside the block
BUCKET_BYTES = 32 << 20  # of text
BATCH = 100_000
BROADCAST_PASSAGES = 100_000  # a pair of longs each
SIMILARITY = 0.75
CHAIN = "doc long, hub long, lo int, hi int, hub_lo int, hub_hi int, parts array<int>"


def _runs(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each window of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out, have = pick(out[: len(out) - step], out[step:]), have + step
    return out


def minimizers(h: np.ndarray, window: int = WINDOW, step: int = 0) -> np.ndarray:
    """Positions of the smallest hash of each window; of runs of one hash only the first, or each ``step``-th."""
    if len(h) == 0:
        return np.empty(0, dtype=np.int64)
    window = min(window, len(h))
    low = _runs(h, window, np.minimum)
    pad = np.zeros(window - 1, dtype=h.dtype)
    chosen = _runs(np.concatenate([pad, low, pad]), window, np.maximum) == h
    new = np.concatenate([[True], h[1:] != h[:-1]])
    if step:
        at = np.arange(len(h))
        new = (at - np.maximum.accumulate(np.where(new, at, 0))) % step == 0
    return np.flatnonzero(chosen & new)


def long_hashes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the LONG words from each place on, out of the shingle hashes ``h``."""
    out = np.zeros(len(at), dtype=np.uint64)
    for step in range(0, LONG, SHINGLE):
        out = mix(out + h[at + step])
    return out


def _word_rows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of texts in one array, GAP_WORDS zeros behind each; starts and lengths."""
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    starts = np.cumsum(sizes + GAP_WORDS) - sizes - GAP_WORDS + CONTEXT
    words = np.zeros(CONTEXT + int(sizes.sum()) + GAP_WORDS * len(texts), dtype=np.uint64)
    for at, w in zip(starts.tolist(), texts, strict=True):
        words[at : at + len(w)] = w
    return words, starts, sizes


def seeds_of(texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Seeds of texts (word hashes) in text order: hash (odd: of a long one), text, place, context."""
    words, starts, sizes = _word_rows(texts)
    if not sizes.any():
        return tuple(np.empty(0, dtype=t) for t in (np.uint64, np.int64, np.int64, np.uint32))
    h = shingle_hashes(words)
    shingles = np.maximum(sizes - SHINGLE + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), shingles)
    real = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    of = np.full(len(h), -1, dtype=np.int64)
    of[real] = owner
    h = np.where(of < 0, np.uint64(2**64 - 1), h)  # no window takes what reaches over an end

    at, far = minimizers(h, DENSE, 2 * DENSE), minimizers(h)
    at, far = at[of[at] >= 0], far[of[far] >= 0]
    far = far[far - starts[of[far]] <= sizes[of[far]] - LONG]
    code = (words >> np.uint64(62)).astype(np.uint32)
    context = np.zeros(len(at), dtype=np.uint32)
    for i, step in enumerate([*range(-CONTEXT, 0), *range(SHINGLE, SHINGLE + CONTEXT)]):
        context |= code[at + step] << np.uint32(2 * i)
    chosen = np.concatenate([h[at] & ~np.uint64(1), long_hashes(h, far) | np.uint64(1)])
    at = np.concatenate([at, far])
    return chosen, of[at], at - starts[of[at]], np.concatenate([context, np.zeros(len(far), dtype=np.uint32)])


def _planes(values: np.ndarray) -> bytes:
    """Non-negative integers as byte planes, as many as the largest needs."""
    wide = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([wide]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def _from_planes(data: memoryview, n: int) -> tuple[np.ndarray, memoryview]:
    wide = data[0]
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :wide] = np.frombuffer(data[1 : 1 + wide * n], dtype=np.uint8).reshape(wide, n).T
    return out.view("<u8").ravel(), data[1 + wide * n :]


def _tied(h: np.ndarray, doc: np.ndarray, place: np.ndarray, context: np.ndarray, crowd: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Anchors (doc, hub, y, 256 x + beside) of seeds sorted by (h, doc, place), and which seeds others need.

    beside: how many of the words left of both seeds agree, times 16, and right of them. The n-th occurrence in a document is tied to the n-th in the other one, counting round, so periodic
    texts stay on one diagonal. With a ``crowd``, only hashes that more than so many documents have are
    tied, and of these only the first and the last document are needed further.
    """
    if not len(h):
        return np.empty((4, 0), dtype=np.int64), np.empty(0, dtype=bool)
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]]) | new_h
    starts, of = np.flatnonzero(new_doc), np.cumsum(new_doc) - 1
    sizes, first, group = np.diff(np.concatenate([starts, [len(h)]])), np.flatnonzero(new_h), np.cumsum(new_h) - 1
    nth, hub_of, last_of = np.arange(len(h)) - starts[of], of[first[group]], np.maximum(of - 1, 0)
    own = of != hub_of
    needed = np.ones(len(h), dtype=bool)
    if crowd:
        docs = np.add.reduceat(new_doc.astype(np.int64), first)
        crowded = docs[group] > crowd
        needed = ~crowded | ~own | (of == (hub_of + docs[group] - 1))
        own &= crowded
    to_hub = np.flatnonzero(own)
    to_last = to_hub[last_of[to_hub] != hub_of[to_hub]]
    row = np.concatenate([to_hub, to_last])
    other = np.concatenate([hub_of[to_hub], last_of[to_last]])
    tied = starts[other] + nth[row] % sizes[other]
    far = (h[row] & np.uint64(1)) == 1
    apart = context[row] ^ context[tied]
    agree = ~(apart | apart >> np.uint32(1)) & np.uint32(0x55555555)
    left, right = (np.where(far, CONTEXT, np.bitwise_count(side)).astype(np.int64) for side in (agree & np.uint32(0xFFFF), agree >> np.uint32(16)))
    beside = left * 16 + right
    row, tied, beside, more = np.concatenate([row, row[far]]), np.concatenate([tied, tied[far]]), np.concatenate([beside, beside[far]]), np.concatenate([np.zeros(len(row), dtype=np.int64), np.full(int(far.sum()), LONG - SHINGLE)])
    return np.stack([doc[row], doc[tied], place[row] + more, 256 * (place[tied] + more) + beside]), needed


def alike(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether enough words beside two places agree."""
    return (left >= ONE_SIDE) | (right >= ONE_SIDE) | (left + right >= BOTH_SIDES)


def _seeds(buckets: int):
    """Blocks of seeds, packed by bucket; what a block's crowds tie among themselves goes along as anchors."""

    def rows(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, doc, place, context = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((place, doc, h))
        h, doc, place, context = h[order], doc[order], place[order], context[order]
        anchors, needed = _tied(h, doc, place, context, CROWD)
        h, doc, place, context = h[needed], doc[needed], place[needed], context[needed]
        bucket = ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        small, kind = (h & np.uint64(0xFFFFFFFF)) >> np.uint64(1), h & np.uint64(1)
        order = np.lexsort((place, doc, kind, bucket))
        cut = np.searchsorted(bucket[order] * 2 + kind[order].astype(np.int64), np.arange(2 * buckets + 1))
        keys, blobs = [], []
        for k in range(2 * buckets):
            at = order[cut[k] : cut[k + 1]]
            if len(at):
                d = doc[at]
                blob = np.array([len(at), d[0]], dtype="<i8").tobytes() + _planes(np.diff(d, prepend=d[0])) + _planes(place[at]) + small[at].astype("<u4").tobytes()
                keys.append(2 * (k // 2))
                blobs.append(bytes([k % 2]) + blob + (b"" if k % 2 else context[at].tobytes()))
        where = anchors[0] % buckets
        for k in np.unique(where):
            keys.append(2 * int(k) + 1)
            blobs.append(anchors[:, where == k].astype("<i8").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words")
        parts, held = [], 0
        for batch in batches:
            docs, texts, words = [], [], 0
            for k, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                docs.append(doc)
                texts.append(word_hashes(text.as_py()))
                words += len(texts[-1])
                if words >= CHUNK_WORDS or k == batch.num_rows - 1:
                    h, of, place, context = seeds_of(texts)
                    parts.append((h, np.array(docs, dtype=np.int64)[of], place, context))
                    held += len(h)
                    docs, texts, words = [], [], 0
                    if held >= BLOCK:
                        yield rows(parts)
                        parts, held = [], 0
        if held:
            yield rows(parts)

    return run


def _unpacked(packed: bytes) -> tuple[np.ndarray, ...]:
    kind, data = packed[0], memoryview(packed)[1:]
    n, low = np.frombuffer(data[:16], dtype="<i8").tolist()
    step, data = _from_planes(data[16:], n)
    place, data = _from_planes(data, n)
    h = np.frombuffer(data[: 4 * n], dtype="<u4").astype(np.uint64) << np.uint64(1) | np.uint64(kind)
    context = np.zeros(n, dtype=np.uint32) if kind else np.frombuffer(data[4 * n :], dtype="<u4")
    return h, low + np.cumsum(step.astype(np.int64)), place.astype(np.int64), context


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors (doc, hub, y, 256 x + beside) out of packed seeds, one bucket after the other."""

    def made(m: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, m.shape[1], BATCH):
            doc, hub, y, x = m[:, at : at + BATCH]
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(hub), pa.array(y.astype(np.int32)), pa.array(x)], ["doc", "hub", "y", "x"])

    def bucket(parts: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        h, doc, place, context = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((place, doc, h))
        return _tied(h[order], doc[order], place[order], context[order])[0]

    now, parts = -1, []
    for batch in batches:
        for key, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if key != now and parts:
                yield from made(bucket(parts))
                parts = []
            now = key
            if key % 2:
                yield from made(np.frombuffer(packed.as_buffer(), dtype="<i8").reshape(4, -1))
            else:
                parts.append(_unpacked(packed.as_py()))
    if parts:
        yield from made(bucket(parts))


# --- chaining -------------------------------------------------------------------------------------


def segments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Anchors sorted by (y, x) to rows (x first, x last, y first, y last, places of the first and last) along diagonals."""
    same = (np.diff(x - y) == 0) & (np.diff(y) <= MERGE)
    start = np.flatnonzero(np.concatenate([[True], ~same]))
    end = np.concatenate([start[1:], [len(x)]]) - 1
    return np.stack([x[start], x[end], y[start], y[end], start, end], axis=1)


def chains(seg: np.ndarray) -> list[list[int]]:
    """Indexes of ``seg`` rows in disjoint collinear chains, best first."""
    n = len(seg)
    if n == 1:
        return [[0]]
    rank = {x: i + 1 for i, x in enumerate(sorted(set(seg[:, 1].tolist())))}
    ends = sorted(rank)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(ends) + 1)
    by_end = sorted(range(n), key=lambda i: seg[i, 3])
    by_start = sorted(range(n), key=lambda i: (seg[i, 2], seg[i, 0]))
    score, prior, put = [0.0] * n, [-1] * n, 0
    rows = seg[:, :4].tolist()
    for i in by_start:
        x0, x1, y0, y1 = rows[i]
        while put < n and rows[by_end[put]][3] < y0:
            j = by_end[put]
            value, k = (score[j] + GAP * (rows[j][1] + rows[j][3]), j), rank[rows[j][1]]
            while k < len(tree):
                if tree[k] < value:
                    tree[k] = value
                k += k & -k
            put += 1
        best, k = (-1e18, -1), bisect.bisect_left(ends, x0)
        while k:
            if tree[k] > best:
                best = tree[k]
            k -= k & -k
        gain = best[0] - GAP * (x0 + y0)
        score[i] = y1 - y0 + SHINGLE + max(0.0, gain)
        prior[i] = best[1] if gain > 0 else -1
    found, used = [], [False] * n
    for i in sorted(range(n), key=lambda i: -score[i]):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = prior[i]
        if path:
            found.append(path[::-1])
    return found


def sure_pieces(m: np.ndarray, min_words: int, similarity: float) -> tuple[np.ndarray, ...]:
    """Spans (doc, hub, from, to in doc) that anchors alone prove to be passages.

    ``m``: rows doc, hub, y, x of anchors sorted by (doc, hub, y, x). Words under an anchor are equal; along a
    diagonal at most MOST_LOST others may lie between two anchors.
    """
    step = np.diff(m[2])
    same = (np.diff(m[0]) == 0) & (np.diff(m[1]) == 0) & (np.diff(m[3] - m[2]) == 0) & (step <= SHINGLE + MOST_LOST)
    start = np.flatnonzero(np.concatenate([[True], ~same]))
    last = np.concatenate([start[1:], [m.shape[1]]]) - 1
    open_words = np.concatenate([[0], np.cumsum(np.maximum(step - SHINGLE, 0))])
    words = m[2, last] + SHINGLE - m[2, start]
    sure = (words >= min_words) & (words - (open_words[last] - open_words[start]) >= similarity * words)
    start, last = start[sure], last[sure]
    return m[0, start], m[1, start], m[2, start], m[2, last] + SHINGLE


def supported(m: np.ndarray) -> np.ndarray:
    """Which anchors count: those whose words beside agree, and those with another one of both documents near.

    ``m``: rows doc, hub, y, x, beside, sorted. Near: of the next two before and behind one at most MERGE words away
    in the document and MOST_SHIFT diagonals off. In a passage with inserted and deleted words anchors are denser.
    """
    out = alike(m[4] >> 4, m[4] & 15)
    for step in (1, 2):
        a, b = m[:, :-step], m[:, step:]
        near = (a[0] == b[0]) & (a[1] == b[1]) & (b[2] - a[2] <= MERGE) & (np.abs(b[3] - b[2] - a[3] + a[2]) <= MOST_SHIFT) & (b[2] > a[2]) & (b[3] > a[3])
        out[:-step] |= near
        out[step:] |= near
    return out


def outdone(spans: list[tuple[int, int, int]], pieces: list[tuple[int, int, int]]) -> list[bool]:
    """Which chains (from, to, hub) lie in a longer sure piece (from, to, hub), or in an equal one of a smaller hub."""
    pieces = sorted(pieces)
    starts, furthest, exact = [], [], {}
    for lo, hi, hub in pieces:
        best = furthest[-1] if furthest else (-1, 0)
        starts.append(lo)
        furthest.append(max(best, (hi, -lo)))
        exact[lo, hi] = min(hub, exact.get((lo, hi), hub))
    out = []
    for lo, hi, hub in spans:
        k = bisect.bisect_right(starts, lo)
        far = furthest[k - 1] if k else (-1, 0)
        out.append(far[0] >= hi and far[0] + far[1] > hi - lo or exact.get((lo, hi), hub) < hub)
    return out


def _doc_chains(m: np.ndarray, pieces: list[tuple[int, int, int]], min_words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Chains (hub, segments) of one document's anchors that no sure piece outdoes.

    Short chains, of a few words that any two texts may share, count only where the words beside both ends agree.
    Inserted and deleted words shift those, but a passage that has some has other anchors too.
    """
    cut = np.flatnonzero(np.diff(m[1]) != 0) + 1
    found = []
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), m.shape[1]], strict=True):
        seg = segments(m[3, a:b], m[2, a:b])
        for path in chains(seg):
            part = seg[path]
            if part[-1, 3] - part[0, 2] + SHINGLE < SHORT and not alike(m[4, a + part[0, 4]] >> 4, m[4, a + part[-1, 5]] & 15):
                continue
            part = part[:, :4]
            if part[-1, 3] - part[0, 2] + SHINGLE + 2 * MARGIN >= min_words:  # what an alignment can reach
                found.append((int(m[1, a]), part))
    drop = outdone([(int(p[0, 2]), int(p[-1, 3]) + SHINGLE, hub) for hub, p in found], pieces) if pieces and len(found) > 1 else [False] * len(found)
    return (x for x, gone in zip(found, drop, strict=True) if not gone)


def _chained(min_words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((5, 0), dtype=np.int64)
        out: list[list] = [[] for _ in range(7)]

        def documents(m: np.ndarray) -> None:
            m = m[:, supported(m)]
            if not m.shape[1]:
                return
            pieces: dict[int, list] = {}
            for doc, hub, lo, hi in zip(*(c.tolist() for c in sure_pieces(m, min_words, similarity)), strict=True):
                pieces.setdefault(doc, []).append((lo, hi, hub))
            cut = np.flatnonzero(np.diff(m[0]) != 0) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), m.shape[1]], strict=True):
                doc = int(m[0, a])
                for hub, part in _doc_chains(m[:, a:b], pieces.get(doc, []), min_words):
                    lo, hi = max(0, part[0, 2] - MARGIN), part[-1, 3] + SHINGLE + MARGIN
                    hub_lo, hub_hi = max(0, part[0, 0] - MARGIN) // GRID * GRID, -(-(part[-1, 1] + SHINGLE + MARGIN) // GRID) * GRID
                    for c, v in zip(out, (doc, hub, lo, hi, hub_lo, hub_hi, part.ravel().tolist()), strict=True):
                        c.append(v)

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.list_(pa.int32())]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc", "hub", "lo", "hi", "hub_lo", "hub_hi", "parts"])
            for c in out:
                c.clear()
            return made

        for batch in batches:  # sorted by (doc, hub, y, x); a document can reach over batches
            if not batch.num_rows:
                continue
            new = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in (0, 1, 2, 3, 3)])
            new[3] >>= 8
            new[4] &= 255
            m = np.concatenate([rest, new], axis=1)
            last = np.flatnonzero(m[0] != m[0, -1])
            keep = last[-1] + 1 if len(last) else 0
            if keep:
                documents(m[:, :keep])
            rest = m[:, keep:]
            if len(out[0]) > 2000:
                yield flush()
        if rest.shape[1]:
            documents(rest)
        yield flush()

    return run


# --- alignment ------------------------------------------------------------------------------------


def _reach(equal: np.ndarray) -> tuple[int, int]:
    """Words and matches of the best extension along ``equal`` (match 1, mismatch -1)."""
    if not len(equal):
        return 0, 0
    gain = np.cumsum(np.where(equal, 1, -1))
    k = int(np.argmax(gain))
    return (k + 1, int(equal[: k + 1].sum())) if gain[k] > 0 else (0, 0)


def columns(hub: np.ndarray, doc: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Aligned places (hub, doc) of one chain in order, its ends extended; parts in slice coordinates."""
    runs = []  # (hub from, doc from, words)
    for i, (x0, x1, y0, y1) in enumerate(parts):
        ex, ey = x1 + SHINGLE, y1 + SHINGLE
        if i:  # the segment before can have taken the first words of this one
            over = max(0, at_x - x0, at_y - y0)
            x0, y0 = x0 + over, y0 + over
            g = min(x0 - at_x, y0 - at_y)
            ahead = np.concatenate([[0], np.cumsum(hub[at_x : at_x + g] == doc[at_y : at_y + g])])
            behind = np.concatenate([[0], np.cumsum((hub[x0 - g : x0] == doc[y0 - g : y0])[::-1])])[::-1]
            k = int((ahead + behind).argmax())
            runs += [(at_x, at_y, k), (x0 - g + k, y0 - g + k, g - k)]
        runs.append((x0, y0, ex - x0))
        at_x, at_y = ex, ey
    x0, _, y0, _ = parts[0]
    g = min(x0, y0)
    left, _ = _reach((hub[x0 - g : x0] == doc[y0 - g : y0])[::-1])
    g = min(len(hub) - at_x, len(doc) - at_y)
    right, _ = _reach(hub[at_x : at_x + g] == doc[at_y : at_y + g])
    runs = [(x0 - left, y0 - left, left), *runs, (at_x, at_y, right)]
    return tuple(np.concatenate([np.arange(r[i], r[i] + r[2]) for r in runs]) for i in (0, 1))


def shared_runs(a: np.ndarray, b: np.ndarray) -> int:
    """How many runs of RUN words of ``b`` are in ``a`` too."""
    if min(len(a), len(b)) < RUN:
        return 0
    mine, theirs = (w[:-2].astype(np.uint64) * np.uint64(0x9E3779B1) + w[1:-1] * np.uint64(0x85EBCA77) + w[2:] for w in (b, a))
    theirs = np.sort(theirs)
    return int((theirs[np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)] == mine).sum())


def common_runs(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (place in a, in b, words) of at least RUN words in a longest common subsequence of two short stretches."""
    if len(a) * len(b) > HOLE or not shared_runs(a, b):
        return []
    best = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int16)
    equal = a[:, None] == b[None, :]
    for i in range(len(a)):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + equal[i]))
    rows, out, i, j = best.tolist(), [], len(a), len(b)
    while i and j:
        if rows[i - 1][j] == rows[i][j]:
            i -= 1
        elif rows[i][j - 1] == rows[i][j]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            if out and out[-1][0] == i + 1 and out[-1][1] == j + 1:
                out[-1] = (i, j, out[-1][2] + 1)
            else:
                out.append((i, j, 1))
    return [r for r in reversed(out) if r[2] >= RUN]


def filled(hub: np.ndarray, doc: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal places (x, y) with those that inserted and deleted words hide: between them and for MARGIN words beyond."""
    fx, fy = np.concatenate([[max(-1, x[0] - MARGIN - 1)], x, [min(len(hub), x[-1] + MARGIN + 1)]]), np.concatenate([[max(-1, y[0] - MARGIN - 1)], y, [min(len(doc), y[-1] + MARGIN + 1)]])
    found = [(x, y)]
    for k in np.flatnonzero((np.diff(fx) > RUN) & (np.diff(fy) > RUN)).tolist():
        a, b = int(fx[k]) + 1, int(fy[k]) + 1
        for i, j, n in common_runs(hub[a : fx[k + 1]], doc[b : fy[k + 1]]):
            found.append((np.arange(a + i, a + i + n), np.arange(b + j, b + j + n)))
    if len(found) == 1:
        return x, y
    x, y = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(x, kind="stable")
    return x[order], y[order]


def _pieces(x: np.ndarray, y: np.ndarray, min_words: int, similarity: float) -> list[tuple[int, int]]:
    """Ranges of the equal places (x, y) that are passages."""
    lost = np.maximum(np.diff(x), np.diff(y)) - 1  # unequal words after each equal one

    def words(i: int, j: int) -> int:
        return int(min(x[j] - x[i], y[j] - y[i])) + 1

    def like(i: int, j: int) -> bool:
        return j - i + 1 >= similarity * (max(x[j] - x[i], y[j] - y[i]) + 1)

    todo, done = [(0, len(x) - 1)], []
    while todo:  # cut at the longest unlike stretch until every piece is alike
        i, j = todo.pop()
        k = i + int(lost[i:j].argmax()) if i < j else i
        if i == j or (lost[k] <= MOST_LOST and like(i, j)):
            piece = (i, j)
            # A piece that is no passage by itself may be one with its neighbour.
            while done and min(words(*piece), words(*done[-1])) < min_words and like(done[-1][0], piece[1]):
                piece = (done.pop()[0], piece[1])
            done.append(piece)
        else:
            todo += [(k + 1, j), (i, k)]
    return [_trimmed(lost, i, j, min_words, words) for i, j in done if words(i, j) >= min_words]


def _trimmed(lost: np.ndarray, i: int, j: int, min_words: int, words) -> tuple[int, int]:
    """Without ends in which more words differ than agree, unless nothing long enough is left."""
    if i == j:
        return i, j
    gain = np.cumsum(1 - lost[i:j])
    a = i + (int(gain.argmin()) + 1 if gain.min() <= 0 else 0)
    gain = np.cumsum(1 - lost[i:j][::-1])
    b = j - (int(gain.argmin()) + 1 if gain.min() <= 0 else 0)
    return (a, b) if a <= b and words(a, b) >= min_words else (i, j)


def passages_of(hub: np.ndarray, doc: np.ndarray, parts: np.ndarray, min_words: int, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """Aligned passages (hub from, to, doc from, to, matches) of a chain, cut wherever it is too unlike."""
    if shared_runs(hub, doc) < LEAST_RUNS * min_words:
        return []
    x, y = columns(hub, doc, parts)
    equal = np.flatnonzero(hub[x] == doc[y])
    if not len(equal):
        return []
    x, y = filled(hub, doc, x[equal], y[equal])
    if min(x[-1] - x[0], y[-1] - y[0]) + 1 < min_words:
        return []
    return [(x[i], x[j] + 1, y[i], y[j] + 1, j - i + 1) for i, j in _pieces(x, y, min_words, similarity)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes (32 bits) of the wanted spans of each text."""
    claim("words")
    for batch in batches:
        docs, los, his, words = [], [], [], []
        for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            w = (word_hashes(text.as_py()) >> np.uint64(32)).astype(np.uint32)
            for span in spans.as_py():
                docs.append(doc)
                los.append(span["lo"])
                his.append(span["hi"])
                words.append(w[span["lo"] : span["hi"]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(los, pa.int32()), pa.array(his, pa.int32()), pa.array(words, pa.binary())], ["doc", "lo", "hi", "words"])


PASSAGE = "doc long, start long, end long, source long, source_start long, source_end long, matches long"


def _aligned(min_words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            cols = [batch.column(n).to_pylist() for n in ("doc", "hub", "lo", "hub_lo")]
            for doc, hub, lo, hub_lo, parts, a, b in zip(*cols, batch.column("parts"), batch.column("hub_words"), batch.column("words"), strict=True):
                p = np.array(parts.as_py()).reshape(-1, 4) - np.array([hub_lo, hub_lo, lo, lo])
                for x0, x1, y0, y1, m in passages_of(np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.uint32), p, min_words, similarity):
                    rows.append((doc, y0 + lo, y1 + lo, hub, x0 + hub_lo, x1 + hub_lo, m))
            names = ["doc", "start", "end", "source", "source_start", "source_end", "matches"]
            yield pa.RecordBatch.from_arrays([pa.array([int(r[i]) for r in rows], pa.int64()) for i in range(7)], names)

    return run


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each passage of a document that an earlier one (smaller id) has too.

    doc, start, end: the passage in words; source, source_start, source_end: where it is in the
    earlier document; matches: aligned equal words.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    seeds = texts.mapInArrow(_seeds(buckets), "bucket int, packed binary")
    anchors = seeds.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_linked, "doc long, hub long, y int, x long")
    dealt = anchors.repartition("doc").sortWithinPartitions("doc", "hub", "y", "x")  # less than two anchors a seed of a document
    chained = stage(dealt.mapInArrow(_chained(min_words, similarity), CHAIN), "chains")

    spans = chained.select("doc", "lo", "hi").unionByName(chained.select(F.col("hub").alias("doc"), F.col("hub_lo").alias("lo"), F.col("hub_hi").alias("hi")))
    wanted = spans.groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    slices = stage(texts.join(wanted, "doc").select("doc", "text", "spans").mapInArrow(_slices, "doc long, lo int, hi int, words binary"), "slices")
    theirs = slices.select(F.col("doc").alias("hub"), F.col("lo").alias("hub_lo"), F.col("hi").alias("hub_hi"), F.col("words").alias("hub_words"))
    both = chained.join(slices, ["doc", "lo", "hi"]).join(theirs, ["hub", "hub_lo", "hub_hi"])
    found = both.mapInArrow(_aligned(min_words, similarity), PASSAGE)
    # Of sources that give the same words, the earliest.
    first = found.groupBy("doc", "start", "end").agg(F.min(F.struct("source", "source_start", "source_end", "matches")).alias("of"))
    return first.select("doc", "start", "end", "of.*")


def cut_passages(docs: DataFrame, passages: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words of their passages; a text with nothing else becomes empty."""
    of, own = free(docs.columns, "_doc", "_spans")
    spans = passages.groupBy(F.col("doc").alias(of)).agg(F.collect_set(F.struct("start", "end")).alias(own))
    if passages.limit(BROADCAST_PASSAGES + 1).count() <= BROADCAST_PASSAGES:
        spans = F.broadcast(spans)  # then the texts are not shuffled
    joined = docs.join(spans, docs[id_col] == F.col(of), "left")

    @F.pandas_udf("string")
    def without(text, spans):
        out = []
        for t, s in zip(text, spans, strict=True):
            if t is None or s is None or not len(s):
                out.append(t)
                continue
            places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
            kept, at = [], 0
            for a, b in sorted((x["start"], x["end"]) for x in s):
                a, b = max(a, at), min(b, len(places))
                if a < b:
                    kept.append(t[places[at][0] : places[a][0]] if a > at else "")
                    at = b
            kept.append(t[places[at][0] :] if at < len(places) else "")
            out.append("".join(kept).rstrip(" \t\n\x0b\x0c\r") if at else t)
        return pd.Series(out, dtype=object)

    # Spark would repeat a deterministic function in each filter on its result, with a Python worker more a core.
    cut = F.when(F.col(own).isNull(), F.col(text_col)).otherwise(without.asNondeterministic()(F.col(text_col), F.col(own)))
    return joined.select(*[cut.alias(c) if c == text_col else docs[c] for c in docs.columns])
