"""Quality rules: base statistics, and a log-likelihood ratio of hashed n-grams.

A document's words and pairs of adjacent words are hashed into ``BUCKETS`` buckets. Two multinomials
with add-one smoothing are estimated over the buckets: one from the trusted documents, one from the
whole corpus. A document's score is the mean over its n-grams of log(trusted / corpus).

A mean dilutes a few bad words in a long text, so single words are judged too: distinct words of each
document, hashed into ``WORD_BUCKETS`` buckets, give a second pair of multinomials (a burst or a long
text counts a word once). ``worst`` is the mean of the ``WORST`` least log ratios among a document's words
(a word as often as it occurs). A trusted document is left out of its own trusted counts here, so the
trusted ones measure what is usual for documents that are not known.

A document is kept unless a base rule fails, or its score lies more than ``SPREADS`` or its worst more
than ``WORST_SPREADS`` standard deviations below the mean of the trusted documents that pass the base
rules. Scores and thresholds are rounded to six decimals, so the verdict does not depend on the order of summation.

Everything is a DataFrame expression. Corpus counts cover every document, trusted counts and thresholds
every trusted one, without a sample. Beyond ``BROADCAST_TRUSTED`` trusted ids the texts are dealt by id to
meet them. Only the log ratios of the buckets, constant in number, pass through the driver.

Defined cases: a null or blank text has no words and fails the base rules. Without trusted documents
only the base rules decide. Rows that repeat are judged each; a document whose score or worst equals its threshold is
kept. A row without an id is judged as any other and never trusted, ids of ``trusted`` that no document has count for
nothing. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.staging import stage

BUCKETS = 8192
WORD_BUCKETS = 65_536
WORST = 3
BROADCAST_TRUSTED = 10_000  # ids
SPREADS = 4
WORST_SPREADS = 3.5
SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` and its lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _neighbours(values: Column) -> Column:
    """Hash of each two adjacent values."""
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, 1, n), F.slice(values, 2, n), lambda a, b: F.xxhash64(a, b))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _covered(starts: Column) -> Column:
    """Words that windows of three at these sorted starts cover."""
    steps = F.transform(starts, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - x, F.lit(3))))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def repeated_words(pairs: Column) -> Column:
    """Words in windows of three that occur at least twice; ``pairs``: hashes of the pairs of adjacent words."""

    def of(hashes: Column) -> Column:
        def starts(s: Column) -> Column:
            again = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            return _let(F.sort_array(F.transform(again, lambda x: x["i"])), _covered)

        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(placed, starts))

    return _let(_neighbours(pairs), of)


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def buckets_of(hashes: Column, buckets: int) -> Column:
    """Bucket of each hash; a repeated n-gram repeats its bucket."""
    return F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def _table(values: list[float]) -> Column:
    """The values as one constant array."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _ratios(counts: dict, start: int, size: int, less: int = 0) -> list[float]:
    """log(trusted / corpus) of the buckets start to start + size; ``less`` is taken from each trusted count above it."""
    pairs = [counts.get(b, (0, 0)) for b in range(start, start + size)]
    total, wanted = sum(n for n, _ in pairs), sum(t for _, t in pairs)
    return [math.log((max(t - less, 0) + 1) / (wanted + size)) - math.log((n + 1) / (total + size)) for n, t in pairs]


def _base(docs: DataFrame, text: Column) -> DataFrame:
    measured = docs.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": repeated_lines(text).cast("long"),
            "n_repeat_words": repeated_words(F.col("_pairs")).cast("long"),
        }
    )
    return measured.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def judge(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, spreads: float = SPREADS, words_into: int = WORD_BUCKETS, worst_of: int = WORST, worst_spreads: float = WORST_SPREADS) -> DataFrame:
    """One row for each document: id, the base statistics, base_failed, score, worst, kept.

    ``trusted``: ids (column ``id_col``) of documents of the kind that is wanted.
    """
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    known = stage(trusted.select(F.col(id_col).alias("_id")).where("_id is not null").distinct(), "trusted").withColumn("_trusted", F.lit(1))
    few = known.count() <= BROADCAST_TRUSTED

    def marked(df: DataFrame, spread: Column) -> DataFrame:
        """``df`` with _trusted, 1 or 0. Rows without an id are dealt by ``spread``, not to one task."""
        if few:
            found = df.join(F.broadcast(known), "_id", "left")
        else:
            dealt = df.withColumn("_spread", F.when(F.col("_id").isNull(), spread).otherwise(F.lit(0).cast("long")))
            found = dealt.join(known.withColumn("_spread", F.lit(0).cast("long")).hint("shuffle_hash"), ["_id", "_spread"], "left").drop("_spread")
        return found.withColumn("_trusted", F.coalesce("_trusted", F.lit(0)))

    def hashed(df: DataFrame) -> DataFrame:
        return df.withColumn("_words", words_of(text)).withColumns({"_hashes": _hashes(F.col("_words")), "_pairs": _neighbours(F.col("_words"))})

    grams_of = buckets_of(F.concat("_hashes", "_pairs"), buckets)
    # Distinct words are counted behind the n-grams, from bucket number `buckets` on.
    single = F.transform(F.array_distinct(buckets_of(F.col("_hashes"), words_into)), lambda b: b + F.lit(buckets))
    grams = hashed(marked(rows, F.xxhash64("_text"))).select(F.col("_trusted").alias("t"), F.explode(F.concat(grams_of, single)).alias("b"))
    counts = {r["b"]: (r["n"], r["t"]) for r in grams.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t")).collect()}  # at most buckets + words_into rows
    wanted = any(t for _, t in counts.values())
    ratio = _table(_ratios(counts, 0, buckets) if wanted else [0.0] * buckets)
    # Ratios for other documents, then for trusted ones, whose own words are counted once less.
    of_words = [_table(_ratios(counts, buckets, words_into, less) if wanted else [0.0] * words_into) for less in (0, 1)]

    def mean(values: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
        return F.when(F.size(values) > 0, F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + of(x)) / F.size(values), 6)).otherwise(F.lit(0.0))

    def least(table: Column) -> Column:
        # Without nulls and outside of lambdas, so the doubles are sorted as such.
        return F.slice(F.sort_array(F.transform(buckets_of(F.col("_hashes"), words_into), lambda b: F.coalesce(F.get(table, b), F.lit(0.0)))), 1, worst_of)

    # Every text is scored once, as an unknown and as a trusted one; which of them it is joins these few numbers, not the text.
    scores = {"score": _let(grams_of, lambda grams: mean(grams, lambda b: F.get(ratio, b))), "_least": least(of_words[0]), "_least_known": least(of_words[1])}
    measured = _base(hashed(rows), text).withColumns(scores).withColumns({"worst": mean(F.col("_least")), "worst_known": mean(F.col("_least_known"))})
    measured = measured.drop("_text", "_words", "_hashes", "_pairs", "_least", "_least_known")
    judged = marked(stage(measured, "measured"), F.xxhash64("n_words", "word_chars", "score", "worst")).withColumn("worst", F.when(F.col("_trusted") == 1, F.col("worst_known")).otherwise(F.col("worst")))

    fine = ~F.col("base_failed")
    if wanted:
        typical = judged.where("_trusted = 1 and not base_failed").agg(*[f(c).alias(f"{n}_{c}") for c in ("score", "worst") for n, f in (("mean", F.avg), ("spread", F.stddev_pop))]).first()
        for c, k in (("score", spreads), ("worst", worst_spreads)):
            if typical[f"mean_{c}"] is not None:
                fine = fine & (F.col(c) >= F.lit(round(typical[f"mean_{c}"] - k * typical[f"spread_{c}"], 6)))
    out = judged.withColumn("kept", fine)
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "worst", "kept")
