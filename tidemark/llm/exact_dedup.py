"""Exact deduplication of an incoming batch against an immutable snapshot.

A snapshot's distinct digests are dealt into buckets of bounded size and each bucket gets one static
binary-fuse filter (8-bit fingerprints, about 1.2 bytes a digest). The incoming batch is grouped
by digest first, so a text that fills a third of the batch is one row from then on. Each distinct
incoming digest is screened by the filter of its bucket: a negative is certainly new, a positive
joins the snapshot's exact bucket. Whatever shares a digest is then compared byte by byte.

Defined cases: a null text counts as empty, and all texts that are empty after normalisation are
equal. Rows that repeat (same id, same text) are each a row of the result. Of equal texts exactly one row
stays: the one with the most code points before normalisation, then the smallest id, one without an id last (keep_id
is null then); of rows that tie in all this, any one. Empty batches and snapshots are fine. Columns other than id and text are ignored, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.staging import stage

WHITE = " \t\n\x0b\x0c\r"
#: Digests a bucket should hold; bounds what one task needs for one filter.
BUCKET_ROWS = 16_384
#: Texts of one digest that are compared in one task, about.
SALT_ROWS = 1024
FILTER_SCHEMA = "bucket int, seed long, segment int, segments int, marks binary"


def normalised(text: Column) -> Column:
    """The text without white space of ``[\\x20\\x09-\\x0D]``; empty for null."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


# --- binary-fuse filter ---------------------------------------------------------------------------


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds) over keys plus seed."""
    h = keys + np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots of each hash, in three consecutive segments."""
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    base = first.astype(np.int64) * segment
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
    mask = segment - 1
    return np.stack([base + (low & mask), base + segment + ((low >> 10) & mask), base + 2 * segment + ((low >> 20) & mask)])


def _marks_of(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) & np.uint64(0xFF)).astype(np.uint8)


def fuse_build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, fingerprints) of a static filter over distinct keys."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = 1 << min(10, max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    for attempt in range(200):
        room = 1.125 + 0.05 * attempt + (0.5 if n < 2000 else 0.1)
        segments = max(1, int(np.ceil(room * n / segment)))
        seed = 0x9E3779B97F4A7C15 * (attempt + 1) & 0x7FFFFFFFFFFFFFFF
        h = _mix(keys, seed)
        at = _places(h, segment, segments)
        slots = (segments + 2) * segment
        degree = np.bincount(at.ravel(), minlength=slots)
        which = np.zeros(slots, dtype=np.int64)
        ids = np.arange(n, dtype=np.int64)
        for row in at:
            np.bitwise_xor.at(which, row, ids)
        order, left = [], n
        while left:
            alone = np.flatnonzero(degree == 1)
            if not len(alone):
                break
            key, first = np.unique(which[alone], return_index=True)
            order.append((key, alone[first]))
            for row in at[:, key]:
                np.subtract.at(degree, row, 1)
                np.bitwise_xor.at(which, row, key)
            left -= len(key)
        if left:
            continue
        marks, mine = np.zeros(slots, dtype=np.uint8), _marks_of(h)
        for key, slot in reversed(order):
            three = at[:, key]
            marks[slot] = 0
            marks[slot] = mine[key] ^ marks[three[0]] ^ marks[three[1]] ^ marks[three[2]]
        return seed, segment, segments, marks.tobytes()
    raise RuntimeError("no filter found; keys are not distinct")


def fuse_has(keys: np.ndarray, seed: int, segment: int, segments: int, marks: bytes) -> np.ndarray:
    """Whether each key may be in the filter; never false for a key it was built from."""
    h = _mix(keys.astype(np.uint64), seed)
    at, table = _places(h, segment, segments), np.frombuffer(marks, dtype=np.uint8)
    return (table[at[0]] ^ table[at[1]] ^ table[at[2]]) == _marks_of(h)


def build_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """One static filter per bucket of a snapshot's digests; a table to keep beside the snapshot."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, marks = fuse_build(pdf["key"].to_numpy().view(np.uint64))
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "seed": [seed], "segment": [segment], "segments": [segments], "marks": [marks]})

    return _dealt(digests, buckets).select("bucket", "key").groupBy("bucket").applyInPandas(build, FILTER_SCHEMA)


def screen(digests: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """``digests`` (one row a digest) with ``maybe``: false where the filter rules the digest out."""
    dealt = _dealt(digests, buckets)
    schema = "digest binary, maybe boolean"

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            maybe = np.zeros(len(left), dtype=bool)
        else:
            f = right.iloc[0]
            maybe = fuse_has(left["key"].to_numpy().view(np.uint64), int(f["seed"]), int(f["segment"]), int(f["segments"]), f["marks"])
        return pd.DataFrame({"digest": left["digest"], "maybe": maybe})

    return dealt.select("bucket", "key", "digest").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(look, schema)


def _dealt(digests: DataFrame, buckets: int) -> DataFrame:
    key = F.xxhash64("digest")
    return digests.select("digest", key.alias("key"), F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"))


# --- the operator ---------------------------------------------------------------------------------


def digest_of(text: Column, digest_bytes: int = 32) -> Column:
    return F.substring(F.unhex(F.sha2(normalised(text), 256)), 1, digest_bytes)


def _groups(rows: DataFrame) -> DataFrame:
    """One row a digest: its rows and the best of them."""
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("n_cp")).alias("less"), F.col("id").isNull().alias("none"), "id", "row")).alias("best"))


def exact_dedup(incoming: DataFrame, snapshot: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """One row for each row of both inputs: id, keep_id, group_size, kept, text_sha256.

    ``digest_bytes`` shortens the digests that group texts; the byte check keeps results the same.
    """

    def rows_of(df: DataFrame, old: bool) -> DataFrame:
        text = F.coalesce(F.col(text_col), F.lit(""))
        full = F.unhex(F.sha2(normalised(text), 256))
        return df.select(F.col(id_col).cast("long").alias("id"), F.char_length(text).alias("n_cp"), full.alias("sha"), F.lit(old).alias("old"))

    def texts_of(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    rows, texts = rows_of(incoming, False), texts_of(incoming)
    if snapshot is not None:
        rows, texts = rows.unionByName(rows_of(snapshot, True)), texts.unionByName(texts_of(snapshot))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "digests").withColumn("digest", F.substring("sha", 1, digest_bytes))
    old, new = _groups(rows.where("old")), _groups(rows.where("not old"))

    most = max(1, rows.groupBy("old").count().agg(F.max("count")).first()[0] or 1)
    buckets = -(-most // BUCKET_ROWS)
    screened = screen(new, build_filters(old, buckets), buckets)
    positive = screened.where("maybe").select("digest")
    hits = positive.join(old.select("digest"), "digest", "left_semi")  # false positives end here
    both = old.unionByName(new.join(hits, "digest", "left_semi"))
    groups = both.groupBy("digest").agg(F.sum("n").alias("n"), F.min("best").alias("best"))
    groups = stage(groups.unionByName(new.join(hits, "digest", "left_anti")), "groups")

    # Byte check: what shares a digest is compared with the row that stays. Rows find their texts by id and
    # whole digest, rows without an id by the digest alone.
    shared = groups.where("n > 1").select("digest", F.col("best.id").alias("keep_id"), F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"))
    row_key = [F.coalesce("id", F.lit(0)).alias("known_id"), F.col("id").isNull().alias("none"), "sha"]
    members = rows.join(shared, "digest").select(*row_key, "digest", "keep_id", "salts").distinct()
    whole = texts.select("id", normalised(F.col("text")).alias("norm")).withColumn("sha", F.unhex(F.sha2("norm", 256))).select(*row_key, "norm")
    full = whole.join(members, ["known_id", "none", "sha"])
    full = stage(full.select(F.when(~F.col("none"), F.col("known_id")).alias("id"), "keep_id", "digest", "salts", "norm", F.monotonically_increasing_id().alias("nth")), "members")  # the texts are shuffled once
    # The one text goes to as many tasks as its copies fill.
    stays = full.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "salts").agg(F.min("norm").alias("stay_norm"))
    stays = stays.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("digest", "salt", "stay_norm")
    full = full.withColumn("salt", F.pmod(F.xxhash64("nth"), F.col("salts")).cast("int"))
    unequal = stage(full.join(stays, ["digest", "salt"]).where("norm <> stay_norm").select("digest").distinct(), "unequal")

    out = rows.join(groups, "digest").select("id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), "best", "sha", "digest", "row")
    if not unequal.isEmpty():
        # Digests that different texts share: those rows are grouped by the whole text instead.
        odd = texts.select("id", "text", normalised(F.col("text")).alias("norm")).withColumn("n_cp", F.char_length("text")).withColumn("sha", F.unhex(F.sha2("norm", 256))).withColumn("digest", F.substring("sha", 1, digest_bytes)).join(unequal, "digest", "left_semi")
        odd = stage(odd.withColumn("row", F.monotonically_increasing_id()), "odd")
        whole = odd.groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("n_cp")).alias("less"), F.col("id").isNull().alias("none"), "id", "row")).alias("best"))
        odd = odd.join(whole, "norm").select("id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), "best", "sha", "digest", "row")
        out = out.join(unequal, "digest", "left_anti").unionByName(odd)
    kept = F.col("row") == F.col("best.row")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
