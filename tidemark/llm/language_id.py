"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) the vectors of
its letters, rotated by their place; a document's vector bundles (adds) the vectors of all its
trigrams; a language's prototype adds the unit vectors of its documents. A document gets the
language whose prototype has the largest cosine with its vector; the score is that cosine.

Letters are lower-cased; everything between letters is one gap, itself a symbol. Letters share
vectors modulo 4095. Defined cases: a text that is null or has no letter is ``und`` with score 0;
ties go to the language that sorts first; without any learned language all are ``und``. Columns
other than id, text and language are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.caches import claim

DIMENSIONS = 1024
SYMBOLS = 4096
#: Labelled documents of each language that its prototype is learned from, at most (those of the smallest hashes),
#: so a language with few documents is learned beside one with many.
SAMPLE = 1500
GROUP = 64


@cache
def _letters() -> np.ndarray:
    """Symbol of each code point; 0 for what is no letter."""
    out = np.zeros(0x110000, dtype=np.int64)
    at = np.array([i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()])
    out[at] = 1 + at % (SYMBOLS - 1)
    return out


@cache
def _vectors() -> tuple[np.ndarray, ...]:
    base = np.random.Generator(np.random.Philox(20240229)).integers(0, 2, (SYMBOLS, DIMENSIONS), dtype=np.int8) * 2 - 1
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


def trigrams(text: str | None) -> np.ndarray:
    """Codes of all trigrams of symbols, with a gap before and after; empty without a letter."""
    codes = _letters()[np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    if not codes.any():
        return np.empty(0, dtype=np.int64)
    s = np.concatenate([[0], codes, [0]])
    s = s[(s != 0) | np.concatenate([[True], s[:-1] != 0])]
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def document_vectors(texts: list[str | None]) -> np.ndarray:
    """The bundled vector of each text (zero without a letter)."""
    grams = [trigrams(t) for t in texts]
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    if not len(owner):
        return out
    pair, count = np.unique(np.concatenate(grams) * len(grams) + owner, return_counts=True)
    kinds, which = np.unique(pair // len(grams), return_inverse=True)
    doc = pair % len(grams)
    first, second, third = _vectors()
    for at in range(0, len(kinds), 4096):
        t = kinds[at : at + 4096]
        v = first[t // SYMBOLS**2] * second[t // SYMBOLS % SYMBOLS] * third[t % SYMBOLS]
        here = (which >= at) & (which < at + 4096)
        counts = np.zeros((len(texts), len(t)), dtype=np.float32)
        counts[doc[here], which[here] - at] = count[here]
        out += counts @ v.astype(np.float32)
    return out


def _units(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _groups(texts: list[str | None]) -> Iterator[np.ndarray]:
    for at in range(0, len(texts), GROUP):
        yield document_vectors(texts[at : at + GROUP])


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("language")
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        done = 0
        for v in _groups(batch.column(1).to_pylist()):
            for lang, row in zip(langs[done : done + len(v)], _units(v).astype(np.float64), strict=True):
                sums[lang] = sums.get(lang, 0) + row
            done += len(v)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], ["lang", "bundle"])


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Prototype of each language, from at most ``sample`` labelled documents of it.

    A first cut by hash, by each language's count, leaves about twice as many as are wanted, so what is ordered and
    moved grows with the number of languages only.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(2.0 * sample) / F.col("n"))
    cuts = counts.select("lang", F.when(share >= 1, F.lit(2**63 - 1)).otherwise(F.floor((share - 0.5) * 2.0**64)).cast("long").alias("cut"))
    # A row a language: as many as there are prototypes, which the driver holds anyway. Texts beyond the cut go unmoved.
    near = rows.join(F.broadcast(cuts), "lang").where("h <= cut")
    order = Window.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    chosen = near.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= sample).select("lang", "text")
    # Eight parts, so at most eight vectors of a language for the driver.
    found = chosen.repartition(8).mapInArrow(_bundles, "lang string, bundle array<double>").collect()
    out: dict[str, np.ndarray] = {}
    for r in found:
        out[r["lang"]] = out.get(r["lang"], 0) + np.array(r["bundle"])
    return {k: out[k] for k in sorted(out)}


def identify(texts: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str], *, text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``texts`` with lang_pred and score."""
    names, matrix = list(prototypes), _units(np.stack(list(prototypes.values()))).astype(np.float32) if prototypes else None
    schema = texts.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language")
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for v in _groups(batch.column(batch.num_columns - 1).to_pylist()):
                cosines = np.zeros((len(v), 1)) if matrix is None else _units(v) @ matrix.T
                best = cosines.argmax(axis=1)
                real = v.any(axis=1) & (matrix is not None)
                langs += [names[k] if ok else "und" for k, ok in zip(best, real, strict=True)]
                scores += [float(min(1.0, max(0.0, c))) if ok else 0.0 for c, ok in zip(cosines.max(axis=1), real, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return texts.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
