"""Near-duplicate documents by min-max hashing.

One hash function over a document's 5-word shingles yields two signature values, its minimum and its
maximum, so 80 functions give 160 values; 40 bands of four values (two minima, two maxima) become
bucket keys. Two sets with a Jaccard similarity of 0.75 share no bucket with probability
(1 - 0.75^4)^40 < 3e-7.

Documents with one and the same shingle set are a single node before banding. In a bucket every
member is compared with the bucket's hub first, the node that shares most with others; pairs that
components have already joined are never compared again. Where a bucket still spans several
components, the members outside its largest component take turns as the hub, a block of hubs a
round, until every pair is either joined or compared, so a round costs rows in proportion to the
bucket and no link is lost. Before that, pairs that share a rare shingle are looked up by
it; what is left can share no more than its common shingles, a bound that spares most pairs of a
bucket. Links are confirmed on the full sets.

Defined cases: a null or blank text has the empty set and is linked with nothing. A text of fewer
than five words is one shingle. Rows that share an id are one node. A row without an id stays alone:
component null, kept. Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.caches import claim
from tidemark.llm.components import components
from tidemark.llm.words import mix, shingle_set
from tidemark.plans.staging import stage

BANDS = 40
PER_BAND = 2  # hash functions a band; each gives a minimum and a maximum
HUBS = 64
BROADCAST_PAIRS = 50_000  # two longs each
RARE = 8  # owners of a shingle up to which it is joined on its own
SIG = "id long, n long, digest binary, bands array<long>"
_SEEDS = np.arange(1, 2 * BANDS * PER_BAND + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_A, _B = mix(_SEEDS[: BANDS * PER_BAND]) | np.uint64(1), mix(_SEEDS[BANDS * PER_BAND :])


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima and maxima of one set of shingle hashes under each function."""
    low = np.full(len(_A), np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(len(_A), dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        h = shingles[at : at + 2048, None] * _A + _B
        low, high = np.minimum(low, h.min(axis=0)), np.maximum(high, h.max(axis=0))
    return low, high


def bands_of(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bucket keys (int64)."""
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(PER_BAND):
        for part in (low[i::PER_BAND], high[i::PER_BAND]):
            key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + part)
    return key.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("words")
    types = [pa.int64(), pa.binary(), pa.list_(pa.int64())]
    for batch in batches:
        n, digest, bands = [], [], []
        for text in batch.column(1):
            s = shingle_set(text.as_py())
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            bands.append(bands_of(*signature(s)) if len(s) else [])
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip((n, digest, bands), types, strict=True))], ["id", "n", "digest", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("words")
    for batch in batches:
        sets = [shingle_set(text.as_py()).view(np.int64) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])


def _alike(a: Column, b: Column, common: Column, percent: int) -> Column:
    return 100 * common >= percent * (a + b - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v), those whose full sets are similar enough."""
    right = sets.select(F.col("id").alias("u"), F.col("shingles").alias("su"))
    if pairs.count() <= BROADCAST_PAIRS:  # then only the sets that are needed are shuffled
        pairs = F.broadcast(pairs)
        right = right.join(F.broadcast(pairs.select("u").distinct()), "u")
    both = sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv")).join(pairs, "v").join(right, "u")
    return both.where(_alike(F.size("su"), F.size("sv"), F.size(F.array_intersect("su", "sv")), percent)).select("u", "v")


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row for each document: id, n_shingles, component_id (smallest id reachable), kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = stage(texts.mapInArrow(_signatures, SIG), "signatures")
    real = sig.where("n > 0 and id is not null")
    reps = real.groupBy("digest").agg(F.min("id").alias("rep"))
    same = stage(real.select("id", "digest").join(reps, "digest").select("id", "rep", "digest").distinct(), "copies")

    own = same.where("id = rep").select("id", "digest")
    banded = real.join(own, ["id", "digest"], "left_semi").select(F.col("id").alias("rep"), F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stage(banded.join(sizes, "band"), "shared")
    # A text that the others were made from shares most buckets with most nodes; it makes the best hub.
    degree = shared.groupBy("rep").agg(F.sum("size").alias("degree"))
    ranked = shared.join(degree, "rep")
    hubs = ranked.groupBy("band").agg(F.max_by("rep", "degree").alias("hub"), F.max("degree").alias("hub_degree"))
    members = stage(ranked.join(hubs, "band").select("band", "rep", "degree", "hub", "hub_degree"), "members")
    wanted = members.select(F.col("rep").alias("id")).distinct()
    sets = stage(texts.join(wanted, "id", "left_semi").mapInArrow(_sets, "id long, shingles array<long>"), "sets")

    def joined(labels: DataFrame, pairs: DataFrame, confirm: bool = True) -> DataFrame:
        """``labels`` after the pairs of nodes (u, v) that the sets confirm."""
        pairs = stage(pairs, "pairs")
        links = stage(_confirmed(pairs, sets, percent), "links") if confirm else pairs
        if links.isEmpty():
            return labels
        lab = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
        roots = components(links.join(lab("u"), "u").join(lab("v"), "v").select(F.col("lu").alias("u"), F.col("lv").alias("v")))
        moved = labels.join(roots.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
        return stage(moved, "labels")

    labels = stage(same.select(F.col("rep").alias("node"), F.col("rep").alias("label")).distinct(), "labels")
    one_id = same.groupBy("id").agg(F.min("rep").alias("u"), F.max("rep").alias("last")).where("u <> last").select("id", "u")
    labels = joined(labels, same.join(one_id, "id").where("rep <> u").select("u", F.col("rep").alias("v")).distinct(), confirm=False)

    spokes = members.where("hub <> rep")
    first = spokes.groupBy("rep").agg(F.max_by("hub", "hub_degree").alias("u")).select("u", F.col("rep").alias("v"))
    labels = joined(labels, first)

    def labelled(df: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
        return df.join(labels.select(F.col("node").alias(node), F.col("label").alias(name)), node)

    rest = labelled(labelled(spokes.select("hub", "rep").distinct(), labels, "rep", "label"), labels, "hub", "hub_label").where("label <> hub_label")
    labels = joined(labels, rest.select(F.col("hub").alias("u"), F.col("rep").alias("v")))

    # Buckets that still span components: every member outside the bucket's largest component takes
    # its turn as a hub, a block of them a round. Any pair across components has such a member.
    here = labelled(members.select("band", "rep", "degree"), labels, "rep", "label")
    parts = here.groupBy("band", "label").count().groupBy("band").agg(F.max_by("label", "count").alias("main"), F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = here.join(parts.where("low <> high").select("band", "main"), "band")
    nth = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("degree"), "rep"))
    outside = mixed.where("label <> main").withColumn("nth", nth)
    inside = mixed.where("label = main").withColumn("nth", F.lit(None).cast("int"))
    open_ = stage(outside.unionByName(inside).select("band", "rep", "nth"), "open")

    # Rare shingles (few owners among the open nodes) are joined on their own. Without one in common,
    # two nodes share at most what is not rare in either, which rules out most pairs of a bucket.
    sizes = sets.select(F.col("id").alias("rep"), F.size("shingles").cast("long").alias("n")).join(open_.select("rep").distinct(), "rep", "left_semi")
    hashes = sets.join(sizes.select(F.col("rep").alias("id")), "id", "left_semi").select(F.col("id").alias("rep"), F.explode("shingles").alias("h"))
    owners = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("owners"), F.min("rep").alias("rep")).where(f"owners <= {RARE}")
    few = stage(hashes.join(owners.where("owners > 1").select("h"), "h"), "rare")
    rare = owners.where("owners = 1").groupBy("rep").count().unionByName(few.groupBy("rep").count()).groupBy("rep").agg(F.sum("count").alias("rare"))
    bounds = stage(sizes.join(rare, "rep", "left").select("rep", "n", (F.col("n") - F.coalesce("rare", F.lit(0))).alias("common")), "bounds")
    met = few.select("h", F.col("rep").alias("u")).join(few.select("h", F.col("rep").alias("v")), "h").where("u < v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("met"))
    for x in ("u", "v"):
        met = labelled(met.join(bounds.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("common").alias(f"c{x}")), x), labels, x, f"l{x}")
    most = F.least("cu", "cv") + F.col("met")
    labels = joined(labels, met.where((F.col("lu") != F.col("lv")) & _alike(F.col("nu"), F.col("nv"), most, percent)).select("u", "v"))
    open_ = open_.join(bounds, "rep").where(f"100 * common >= {percent} * n")
    open_ = stage(open_.join(open_.groupBy("rep").agg(F.collect_set("band").alias("bands")), "rep"), "open")  # 40 bands at most
    done, block = 0, HUBS
    while True:
        now = labelled(open_, labels, "rep", "label")
        still = now.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("nth").alias("last")).where(f"low <> high and last > {done}").select("band")
        active = stage(now.join(still, "band", "left_semi"), "active")
        if active.isEmpty():
            break
        hub = active.where((F.col("nth") > done) & (F.col("nth") <= done + block)).select("band", F.col("rep").alias("u"), F.col("nth").alias("hub_nth"), F.col("label").alias("hub_label"), F.col("n").alias("hub_n"), F.col("common").alias("hub_common"), F.col("bands").alias("hub_bands"))
        near = f"100 * least(common, hub_common) >= {percent} * (n + hub_n - least(common, hub_common))"
        once = "band = array_min(array_intersect(bands, hub_bands))"  # a pair shares several buckets
        pairs = active.join(hub, "band").where(f"label <> hub_label and (nth is null or nth > hub_nth) and {near} and {once}")
        labels = joined(labels, pairs.select(F.least("u", "rep").alias("u"), F.greatest("u", "rep").alias("v")).distinct())
        done, block = done + block, min(2 * block, 512)

    found = same.select("id", "rep").join(labels.select(F.col("node").alias("rep"), "label"), "rep")
    label = found.groupBy("id").agg(F.min("label").alias("label"))
    out = sig.select("id", "n").join(label, "id", "left")
    component = F.coalesce("label", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
