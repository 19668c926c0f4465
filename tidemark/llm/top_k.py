"""Exact top-k search by inner product over vectors in order of their lengths.

Components are turned into integers (floor of 256 times each), so scores are exact. Candidates are dealt into
shards of bounded size; a shard is a run of chunks in order of descending length. A task takes one block of
queries and one shard and reads its chunks in order: a query is done as soon as its length times the chunk's
greatest length falls below its k-th best score (Cauchy-Schwarz), and the rest of the shard is passed over
once all of the block are done. Inside a chunk vectors are compared in the order of singular directions: partial
sums over the first of them, plus the product of what both vectors have left, bound a score from above, and only pairs
that pass are summed up. A first look at the ``HEAD`` longest vectors gives each query a k-th best score to
start from; queries that need long vectors only share blocks, and chunks too short for a block are not sent to it.

The singular directions come from a bounded sample; they decide how much is passed over, never what is found.

Defined cases: vectors that are null or hold null or non-finite components (256 times a component included) take
no part, nor do rows without an id. Shorter vectors count as filled up with zeros; an empty one scores 0.
A query's own row is no candidate for it, other rows with its id or its vector are; rows that repeat are queries and
candidates each. Ties go to the smaller id. Scores beyond a long count as its limit. Of equal vectors only the
k + 1 smallest ids can be among the best of any query, so a vector that fills a third of the table is a few
rows from then on. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.sampling import smallest_hashes
from tidemark.plans.shipping import ship
from tidemark.plans.staging import stage

#: Vectors of a chunk, of a shard, queries of a block (about), the longest vectors that are looked at first,
#: vectors that singular directions are learned from (at most).
CHUNK, SHARD, BLOCK, HEAD, SAMPLE = 512, 16_384, 1024, 1024, 4096
#: Steps in which lengths are told apart when chunks are sent to blocks.
LEVELS = 256
#: Pairs whose components are gathered at once.
GATHER = 32_768
LEAST = np.iinfo(np.int64).min
PACKED = "vec_id long, norm double, wide boolean, data binary"
PIECES = "part int, seq int, top double, ids array<long>, rows array<long>, floors array<long>, own array<boolean>, wide boolean, data binary"


# --- vectors as bytes -----------------------------------------------------------------------------


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Integer vectors: 16 bits a component where they fit, else doubles."""
    for batch in batches:
        norms, wides, data = [], [], []
        for x in batch.column(1):
            with np.errstate(over="ignore", invalid="ignore"):
                v = np.floor(256 * np.array(x.as_py(), dtype=np.float64))
                norm = float(np.sqrt((v * v).sum()))
            ok, wide = bool(np.isfinite(v).all()), bool(np.abs(v).max(initial=0) > 32_767)
            norms.append(norm if ok else None)
            wides.append(wide)
            data.append((v if wide else v.astype("<i2")).tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(norms, pa.float64()), pa.array(wides, pa.bool_()), pa.array(data, pa.binary())], ["vec_id", "norm", "wide", "data"])


def _matrix(data: list[bytes], wides: list[bool], width: int) -> np.ndarray:
    out = np.zeros((len(data), width))
    for row, d, wide in zip(out, data, wides, strict=True):
        v = np.frombuffer(d, "<f8" if wide else "<i2")
        row[: len(v)] = v
    return out


def _unpacked(data: bytes, wide: bool, width: int) -> np.ndarray:
    return np.frombuffer(data, "<f8" if wide else "<i2").astype(np.float64).reshape(-1, width)


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, norm, wide and data of the rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~odd).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    return rows.mapInArrow(_quantised, PACKED).where("data is not null")


def _directions(sample: np.ndarray) -> np.ndarray:
    """Singular directions of the sample's rows, the strongest first."""
    width = sample.shape[1]
    scale = np.abs(sample).max(initial=0)
    if not scale:
        return np.eye(width)
    return np.linalg.eigh((sample / scale).T @ (sample / scale))[1][:, ::-1]


# --- one block of queries against chunks ----------------------------------------------------------


class Search:
    """The best k so far of each query of a block, and what bounds the rest."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, floors: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.rows, self.k, self.turn = ids, rows, k, turn
        self.least = floors.astype(np.int64)  # a k-th best score known from elsewhere, or LEAST
        self.width = rows.shape[1]
        self.cuts = sorted({c for c in (self.width // 8, self.width // 4, self.width // 2) if c})
        with np.errstate(over="ignore"):
            self.norms = np.sqrt((rows * rows).sum(axis=1))
        self.turned, self.rest = self._turned(rows)
        self.q, self.s, self.i = (np.empty(0, np.int64) for _ in range(3))
        self.summed = 0  # pairs whose scores were computed whole

    def _turned(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        with np.errstate(over="ignore", invalid="ignore"):
            turned = rows @ self.turn
            return turned, [np.sqrt((turned[:, c:] ** 2).sum(axis=1)) for c in self.cuts]

    def _floor(self) -> np.ndarray:
        """Scores that a candidate must reach, as doubles that are never too large."""
        f = self.least.astype(np.float64)
        return np.where(self.least == LEAST, -np.inf, f - 0.5 - 1e-9 * np.abs(f))

    def live(self, longest: float) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.flatnonzero(~(self.norms * longest * (1 + 1e-9) < self._floor()))

    def feed(self, ids: np.ndarray, own: np.ndarray, rows: np.ndarray, longest: float) -> bool:
        """Take a chunk in; false if neither it nor any shorter one can matter."""
        live = self.live(longest)
        if not len(live):
            return False
        top = max(np.abs(self.rows).max(initial=0), 1) * max(np.abs(rows).max(initial=0), 1) * self.width
        q, c = self._passing(live, rows, longest) if top < 1e300 else (np.repeat(live, len(rows)), np.tile(np.arange(len(rows)), len(live)))
        for at in range(0, len(q), GATHER):
            qa, ca = q[at : at + GATHER], c[at : at + GATHER]
            if top < 2**53:
                s = np.einsum("ij,ij->i", self.rows[qa], rows[ca]).astype(np.int64)
            else:
                s = np.array([min(max(sum(int(a) * int(b) for a, b in zip(self.rows[x], rows[y], strict=True)), LEAST), 2**63 - 1) for x, y in zip(qa, ca, strict=True)], dtype=np.int64)
            self.summed += len(qa)
            mine = own[ca] & (self.ids[qa] == ids[ca])
            mine[mine] = (self.rows[qa[mine]] == rows[ca[mine]]).all(axis=1)
            take = ~mine & (s >= self.least[qa])
            self._keep(qa[take], s[take], ids[ca[take]])
        return True

    def _passing(self, live: np.ndarray, rows: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose bounds reach what the query needs."""
        turned, rest = self._turned(rows)
        floor = self._floor()
        slack = 1e-9 * self.norms * longest + 1e-6
        done, first = 0, True
        q = c = part = None
        for cut, mine, theirs in zip(self.cuts, self.rest, rest, strict=True):
            if first:
                part = self.turned[live, :cut] @ turned[:, :cut].T
                li, c = np.nonzero(part + mine[live][:, None] * theirs[None, :] + slack[live][:, None] >= floor[live][:, None])
                part, q, first = part[li, c], live[li], False
            else:
                ok = np.empty(len(q), dtype=bool)
                for at in range(0, len(q), GATHER):
                    s = slice(at, at + GATHER)
                    part[s] += np.einsum("ij,ij->i", self.turned[q[s], done:cut], turned[c[s], done:cut])
                    ok[s] = part[s] + mine[q[s]] * theirs[c[s]] + slack[q[s]] >= floor[q[s]]
                q, c, part = q[ok], c[ok], part[ok]
            done = cut
        if first:
            return np.repeat(live, len(rows)), np.tile(np.arange(len(rows)), len(live))
        return q, c

    def _keep(self, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        if not len(q):
            return
        q, s, i = (np.concatenate(x) for x in ((self.q, q), (self.s, s), (self.i, i)))
        order = np.lexsort((i, ~s, q))
        q, s, i = q[order], s[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.s, self.i = q[keep], s[keep], i[keep]
        full = rank == self.k - 1
        self.least[q[full]] = np.maximum(self.least[q[full]], s[full])


# --- the operator ---------------------------------------------------------------------------------


def _floors_from(head: tuple, turn: np.ndarray, k: int):
    ids, own, rows, longest = head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qids = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            mine = _matrix(batch.column(3).to_pylist(), batch.column(2).to_pylist(), rows.shape[1])
            search = Search(qids, mine, np.full(len(qids), LEAST), turn, k)
            if len(ids):
                search.feed(ids, own, rows, longest)
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                need = np.where(search.least == LEAST, -np.inf, (search._floor()) / search.norms)
            need = np.where(np.isnan(need), -np.inf, need)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(search.least), pa.array(need)], ["vec_id", "norm", "wide", "data", "least", "need"])

    return run


def _pack(width: int, most: int):
    """Runs of at most ``most`` rows of a part as one row that holds all their vectors."""
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.bool_(), pa.binary()]
    names = ["part", "seq", "top", "ids", "rows", "floors", "own", "wide", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, seq = [], None, 0

        def made() -> pa.RecordBatch:
            norms, ids, rows, floors, own, wides, data = zip(*held, strict=True)
            wide, matrix = any(wides), _matrix(data, wides, width)
            cells = [part, seq, norms[0], ids, rows, floors, own, wide, (matrix if wide else matrix.astype("<i2")).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], names)

        for batch in batches:
            for of, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (of != part or len(held) == most):
                    yield made()
                    held, seq = [], seq + 1
                if of != part:
                    part, seq = of, 0
                held.append(row)
        if held:
            yield made()

    return run


def _searched(turn: np.ndarray, k: int):
    """Blocks of queries against the chunks that follow them, in order of length."""
    width = turn.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, searches, going = None, [], False

        def found() -> Iterator[pa.RecordBatch]:
            for names, search in searches:
                if len(search.q):
                    yield pa.RecordBatch.from_arrays([pa.array(names[search.q]), pa.array(search.ids[search.q]), pa.array(search.i), pa.array(search.s)], ["q", "query_id", "vec_id", "score"])

        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            for j in range(batch.num_rows):
                cell = lambda n, j=j: batch.column(at[n])[j].as_py()
                if (block := (cell("block"), cell("shard"))) != key:
                    yield from found()
                    key, searches, going = block, [], True
                if not going:
                    continue
                rows = _unpacked(cell("data"), cell("wide"), width)
                ids = np.array(cell("ids"), dtype=np.int64)
                if cell("kind") == 0:
                    searches.append((np.array(cell("rows"), dtype=np.int64), Search(ids, rows, np.array(cell("floors"), dtype=np.int64), turn, k)))
                else:
                    own, longest = np.array(cell("own"), dtype=bool), cell("top")
                    going = any([s.feed(ids, own, rows, longest) for _, s in searches])
        yield from found()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows of ``vectors``.

    ``queries`` are rows of ``vectors``: each query's own row is left out of its result.
    """
    ship(vectors.sparkSession)
    packed = quantised(vectors, id_col, vector_col)
    copies = Window.partitionBy("wide", "data").orderBy("vec_id")
    few = packed.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    # Of rows with the same id and vector the first is the one that a query of both calls its own.
    before = F.lag("vec_id").over(copies)
    few = stage(few.withColumn("own", ~F.coalesce(before == F.col("vec_id"), F.lit(False))).drop("copy"), "candidates")
    asked = stage(quantised(queries, id_col, vector_col), "queries")

    size = F.octet_length("data") / F.when(F.col("wide"), F.lit(8)).otherwise(F.lit(2))
    facts = few.agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("width"), F.max("norm").alias("longest")).first()
    longer = asked.agg(F.max(size).alias("width")).first()["width"]
    width = int(max(facts["width"] or 0, longer or 0, 1))
    sample = smallest_hashes(few, "data", SAMPLE).where("not wide").select("data").limit(SAMPLE).collect()
    turn = _directions(_matrix([bytes(r["data"]) for r in sample], [False] * len(sample), width))
    head = few.orderBy(F.desc("norm"), "vec_id").limit(max(16, min(HEAD, 2**22 // width))).collect()
    head_rows = _matrix([bytes(r["data"]) for r in head], [r["wide"] for r in head], width)
    looked = (np.array([r["vec_id"] for r in head], dtype=np.int64), np.array([r["own"] for r in head], dtype=bool), head_rows, head[0]["norm"] if head else 0.0)
    floors = asked.select("vec_id", "norm", "wide", "data").mapInArrow(_floors_from(looked, turn, k), PACKED + ", least long, need double")
    floors = stage(floors.withColumn("q", F.monotonically_increasing_id()), "floors")

    longest = facts["longest"] or 0.0
    step = longest / LEVELS if 0 < longest < 1e300 else 1.0
    level = lambda c: F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.floor(F.col(c) / step))).cast("int")
    floors = floors.withColumn("level", F.when(F.col("need") > 0, level("need")).otherwise(F.lit(0)))
    counts = {r["level"]: r["count"] for r in floors.groupBy("level").count().collect()}
    first, ways, lows, held = [0] * LEVELS, [1] * LEVELS, [], 0
    for at in range(LEVELS):  # neighbouring levels share a block until it is full; a level beyond that is split
        n = counts.get(at, 0)
        if not lows or held and held + n > BLOCK:
            lows, held = [*lows, at], 0
        first[at], held = len(lows) - 1, held + n
        if n > BLOCK:
            ways[at] = -(-n // BLOCK)
            lows, held = lows + [at] * (ways[at] - 1), BLOCK
    reach = [sum(low <= at for low in lows) for at in range(LEVELS)]
    of = lambda values, c: F.element_at(F.array(*map(F.lit, values)), c + 1)

    shards = -(-max(facts["n"], 1) // SHARD)
    none = F.lit(None).cast("long")
    dealt = few.withColumn("part", F.pmod(F.xxhash64("data"), F.lit(shards)).cast("int")).repartition("part").sortWithinPartitions("part", F.desc("norm"))
    chunks = stage(dealt.select("part", "norm", "vec_id", none.alias("row"), none.alias("floor"), "own", "wide", "data").mapInArrow(_pack(width, CHUNK), PIECES), "chunks")
    chunks = chunks.select("*", F.explode(F.sequence(F.lit(0), of(reach, level("top")) - 1)).alias("block")).withColumnRenamed("part", "shard").withColumn("kind", F.lit(1))
    dealt = floors.withColumn("part", (of(first, F.col("level")) + F.pmod(F.xxhash64("q"), of(ways, F.col("level")))).cast("int")).repartition("part").sortWithinPartitions("part")
    blocks = stage(dealt.select("part", "norm", "vec_id", "q", "least", F.lit(True).alias("own"), "wide", "data").mapInArrow(_pack(width, BLOCK), PIECES), "blocks")
    blocks = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).withColumnRenamed("part", "block").withColumn("kind", F.lit(0))
    met = blocks.unionByName(chunks).repartition("block", "shard").sortWithinPartitions("block", "shard", "kind", "seq")
    found = met.mapInArrow(_searched(turn, k), "q long, query_id long, vec_id long, score long")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
