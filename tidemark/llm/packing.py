"""Packing documents into fixed windows by non-negative least squares.

Documents are cut at multiples of the window, so a document has full pieces and one shorter rest.
Piece lengths are rounded up to units of 8 tokens, which leaves a histogram of 128 counts whatever
the size of the corpus. All combinations of at most three lengths that fill a window exactly are
enumerated; non-negative least squares finds repeat counts that explain the histogram; these are
rounded down to what the histogram holds, and the pieces left over are packed greedily, largest
first, while that fills windows. What then remains (all of it rests that no others complete) is laid
end to end within hash shards and cut at window ends, so such windows are full too. The plan (some
thousand patterns with multiplicities) is all that the driver sees. Pieces get a rank among those of
their length (within hash shards of bounded size, so no length is hot), and rank and plan
determine sequence and place.

Defined cases: a null or empty text is one piece of the end id. Rows that repeat, also with one id,
are packed each. An empty table has no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.caches import claim, register
from tidemark.llm.chunks import ChunkEncoder
from tidemark.plans.staging import stage

WINDOW = 1024
UNIT = 8
DEPTH = 3
END = 0
SHARD_ROWS = 20_000
KNOWN_WORDS = 1_000_000  # whose ids a worker remembers
LEAST_FILL = 127 / 128  # of a window that whole pieces fill; below, pieces are cut
PIECE = "doc long, row long, start long, length long, ids_crc32 long, doc_tokens long"
NAMES = ["doc", "row", "start", "length", "ids_crc32", "doc_tokens"]
_ENCODERS: dict[str, ChunkEncoder] = {}
register("packing", _ENCODERS.clear)


def encoder(path: str) -> ChunkEncoder:
    """Ids of the tokenizer file at ``path``, remembered by worker."""
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _ENCODERS[path] = ChunkEncoder(lambda s: array("I", tokenizer.encode(s, add_special_tokens=False).ids).tobytes(), most=KNOWN_WORDS, twice=True)
    return _ENCODERS[path]


def narrow(ids: bytes) -> bytes:
    """Ids of 32 bits in 16 where they fit."""
    wide = np.frombuffer(ids, dtype="<u4")
    return wide.astype("<u2").tobytes() if wide.max(initial=0) < 2**16 else ids


def widened(ids: bytes, n: int) -> bytes:
    """Undoes ``narrow`` for ``n`` ids."""
    return ids if len(ids) == 4 * n else np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()


def _pieces(path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing")
        encode, end = encoder(path), np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                for at in range(0, total, window):
                    cut = ids[4 * at : 4 * (at + window)]
                    rows.append((doc, row, at, len(cut) // 4, zlib.crc32(cut), total, None if len(cut) == 4 * window else narrow(cut)))
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], [*NAMES, "ids"])

    return run


# --- the plan -------------------------------------------------------------------------------------


def combinations(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Non-increasing tuples of at most ``depth`` lengths that sum to ``units``."""

    def grow(left: int, most: int, parts: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif parts:
            for first in range(min(left, most), 0, -1):
                if first * parts < left:
                    break
                for rest in grow(left - first, first, parts - 1):
                    yield (first, *rest)

    return list(grow(units, units, depth))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Least squares of ``a x = b`` over x >= 0, by an active set on the normal equations."""
    gram, goal = a.T @ a, a.T @ b
    x, free = np.zeros(len(goal)), np.zeros(len(goal), dtype=bool)
    for _ in range(rounds):
        slope = goal - gram @ x
        slope[free] = -np.inf
        k = int(np.argmax(slope))
        if slope[k] <= 1e-7:
            break
        free[k] = True
        while True:
            at = np.flatnonzero(free)
            z = np.linalg.solve(gram[np.ix_(at, at)] + 1e-9 * np.eye(len(at)), goal[at])
            bad = z <= 0
            if not bad.any():
                x[at] = z
                break
            now = x[at]
            step = np.min(now[bad] / np.maximum(now[bad] - z[bad], 1e-300))
            x[at] = np.maximum(now + step * (z - now), 0)
            x[at[x[at] <= 1e-12]] = 0
            free[at[x[at] == 0]] = False
    return x


def plan(histogram: dict[int, int], units: int, least: float = 0.0) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences); no piece twice, and all of them if ``least`` is 0.

    ``least``: share of a window that whole pieces must fill; with the first that do not, planning ends.
    """
    left = np.zeros(units + 1, dtype=np.int64)
    for length, count in histogram.items():
        left[length] = count
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], most: int) -> None:
        need = np.bincount(pattern, minlength=units + 1)
        n = int(min(most, (left[need > 0] // need[need > 0]).min()))
        if n > 0:
            left[:] -= n * need
            out.append((pattern, n))

    usable = [p for p in combinations(units) if all(left[k] for k in p)]
    if usable:
        a = np.stack([np.bincount(p, minlength=units + 1) for p in usable], axis=1).astype(float)
        scale = float(left.max())
        counts = nnls(a, left / scale) * scale
        for k in np.argsort(-counts, kind="stable"):
            take(usable[k], int(counts[k]))
    while left.any():
        pattern, room, spare = [], units, left.copy()
        while room and (fits := np.flatnonzero(spare[: room + 1])).size:
            k = int(fits[-1])
            pattern.append(k)
            spare[k] -= 1
            room -= k
        if units - room < least * units:
            break
        take(tuple(pattern), int(left.sum()))
    return out


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence, sequences and slot of each block of ranks."""
    blocks, given, sequence = defaultdict(list), defaultdict(int), 0
    for pattern, n in patterns:
        for slot, k in enumerate(pattern):
            blocks[k].append((given[k], sequence, slot))
            given[k] += n
        sequence += n
    return {k: tuple(np.array(c) for c in zip(*b, strict=True)) for k, b in blocks.items()}


def _assigned(places: dict[int, tuple[np.ndarray, ...]], quota: dict[int, int]):
    """Sequence and slot of each piece; sequence -1 beyond the quota of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, ranks = batch.column("bin").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = np.full(len(bins), -1, dtype=np.int64), np.zeros(len(bins), dtype=np.int64)
            for k in np.unique(bins):
                at = np.flatnonzero((bins == k) & (ranks < quota.get(int(k), 0)))
                if len(at):
                    first, start, slots = places[int(k)]
                    block = np.searchsorted(first, ranks[at], side="right") - 1
                    sequence[at], slot[at] = start[block] + ranks[at] - first[block], slots[block]
            names = [*NAMES, "shard", "ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(slot)], [*names, "sequence_id", "slot"])

    return run


def _cut(window: int):
    """Pieces that lie at ``at`` of their shard, cut where windows end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, start, length, crc, total, shard, at, ids in zip(*(batch.column(n).to_pylist() for n in ("doc", "start", "length", "ids_crc32", "doc_tokens", "shard", "at")), batch.column("ids"), strict=True):
                done, packed = 0, None
                while done < length:
                    take = min(length - done, window - (at + done) % window)
                    if take < length and packed is None:
                        packed = widened(ids.as_py(), length)
                    part = crc if take == length else zlib.crc32(packed[4 * done : 4 * (done + take)])
                    rows.append((doc, start + done, take, part, total, (shard << 32) + (at + done) // window, (at + done) % window))
                    done += take
            names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], names)

    return run


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    units = window // UNIT
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    pieces = stage(texts.mapInArrow(_pieces(tokenizer, window), f"{PIECE}, ids binary"), "pieces").withColumn("bin", F.ceil(F.col("length") / UNIT).cast("int"))
    histogram = {r["bin"]: r["count"] for r in pieces.groupBy("bin").count().collect()}  # at most `units` rows
    shards = max(1, sum(histogram.values()) // SHARD_ROWS)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "start"), F.lit(shards)))
    before = Window.partitionBy("bin").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("bin", "shard").count().select("bin", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("bin", "shard").orderBy("row", "start")) - 1
    ranked = dealt.withColumn("nth", nth).join(base, ["bin", "shard"]).withColumn("rank", F.col("base") + F.col("nth"))
    patterns = plan(histogram, units, LEAST_FILL)
    quota: dict[int, int] = defaultdict(int)
    for pattern, n in patterns:
        for k in pattern:
            quota[k] += n
    loose = [k for k, n in histogram.items() if n > quota[k]]
    ids = F.when(F.col("bin").isin(loose), F.col("ids")).alias("ids")  # only where pieces may be cut
    chosen = ranked.select(*NAMES, "shard", "bin", "rank", ids).mapInArrow(_assigned(_places(patterns), dict(quota)), f"{PIECE}, shard long, ids binary, sequence_id long, slot long")
    if loose:
        chosen = stage(chosen, "chosen")
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(ahead), F.lit(0))
    out = chosen.where("sequence_id >= 0").select("doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
    if loose:
        before = Window.partitionBy("shard").orderBy("row", "start").rowsBetween(Window.unboundedPreceding, -1)
        laid = chosen.where("sequence_id < 0").select(*NAMES, "shard", "ids", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("at"))
        cut = laid.mapInArrow(_cut(window), "doc long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
        out = out.unionByName(cut.withColumn("sequence_id", F.col("sequence_id") + sum(n for _, n in patterns)))
    return out.withColumnRenamed("doc", id_col)
