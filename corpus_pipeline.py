"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it kept, with the columns of ``documents``; the
last one returns the packed pieces. ``run`` writes every stage as Parquet to the shared folder and the
next one reads it back, so a lost executor never costs more than one stage. What a stage has written on
the way is deleted as soon as what it decides is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import exact_dedup, normalised
from tidemark.llm.language_id import identify, learn
from tidemark.llm.names import free
from tidemark.llm.near_dedup import near_dedup
from tidemark.llm.packing import pack
from tidemark.llm.substring_dedup import cut_passages, repeated_passages
from tidemark.plans.shipping import ship
from tidemark.plans.staging import scratch, stage
from tidemark.plans.tables import table

#: A document whose best cosine is below this is in none of the learned languages.
LEAST_COSINE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach; those without a letter or unlike all go."""
    ship(spark)
    plain = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))  # so no name meets those that are added
    found = identify(plain, learn(docs), plain.columns, text_col=f"_{docs.columns.index('text')}")
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_COSINE)).select(*plain.columns).toDF(*docs.columns)


def _one(docs: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each combination of ``keys``."""
    (row,) = free(docs.columns, "_row")
    return docs.groupBy(*keys).agg(F.min(F.struct(*columns)).alias(row)).select(f"{row}.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group with equal texts, also where rows share an id or have none."""
    ship(spark)
    first = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.lit(False))
    id_, none, sha, less = free(docs.columns, "_id", "_none", "_sha", "_less")
    id_keys = [F.coalesce("doc_id", F.lit(0)).alias(id_), F.col("doc_id").isNull().alias(none)]
    with scratch() as keep:
        decided = exact_dedup(docs.where(~first), docs.where(first))
        kept = keep(decided.where("kept").select(*id_keys, F.unhex("text_sha256").alias(sha)).distinct(), "one-of-equals")
    rows = docs.select("*", *id_keys, F.unhex(F.sha2(normalised(F.col("text")), 256)).alias(sha), (-F.char_length(F.coalesce("text", F.lit("")))).alias(less))
    return _one(rows.join(kept, [id_, none, sha], "left_semi"), [id_, none, sha], [less, *docs.columns]).select(*docs.columns)


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``key``: the id; a hash beyond all ids for rows without one and for further texts of one id."""
    low, high = free(docs.columns, "_low", "_high")
    text = F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")))
    shared = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias(low), F.max(text).alias(high)).where(F.col(low) != F.col(high))
    shared = stage(shared.select("doc_id", low), "shared-ids")
    far = F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).bitwiseAND(2**61 - 1) + F.lit(2**62)
    own = F.col("doc_id").isNotNull() & (F.col(low).isNull() | (F.col(low) == text))
    return docs.join(shared, "doc_id", "left").select(*docs.columns, F.when(own, F.col("doc_id").cast("long")).otherwise(far).alias(key))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates; different texts of one id are judged each."""
    ship(spark)
    (key,) = free(docs.columns, "_key")
    keyed = _keyed(docs, key)
    with scratch() as keep:
        kept = keep(near_dedup(keyed, id_col=key).where("kept").select(key).distinct(), "one-of-alike")
    return _one(keyed.join(kept, key, "left_semi"), [key], docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; documents of nothing else go."""
    ship(spark)
    with scratch() as keep:
        passages = keep(repeated_passages(docs), "passages")
    cut = cut_passages(docs, passages).where(F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    ship(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", language), ("exact dedup", exact), ("MinHash near-dedup", near), ("substring dedup", substrings), ("packing", packed)]

#: No stage but exact dedup is an SQL expression; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        with scratch() as keep:
            docs = keep(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
