"""What each filter removes in every order of a set of filters, from counts by mask alone.

A document's failures are a bit mask. Counts by part and mask are all that the audit needs: the subset-zeta
transform turns a part's counts by mask into the number of documents that survive each subset of the filters
(those whose mask avoids it), and a step of an order is the difference between two neighbouring subsets. The
same transform over counts of labelled documents says what a step costs. Documents are read once; from then on
a row is a digest, a part and a few bits.

Defined cases: a null text counts as empty and a null part as the empty string. A document without an id is
never a repetition of another and never makes another one; rows that share an id and a text repeat no smaller id,
so they all pass. A document has a label if any row of ``labels`` with its id has it; ids in ``labels``
alone count for nothing, null labels are no labels. Repeated rows each count. Without documents there is no row.
Columns other than id, text and part are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.staging import stage

WHITE = "\t\n\x0b\x0c\r"
#: Bit i of a mask belongs to the i-th letter.
FILTERS = "ABCDE"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one whole text: A to D."""
    spaced = text
    for c in WHITE:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    words = F.array_remove(F.split(spaced, " "), "")
    n = F.size(words)
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * n, "C": 100 * capitals > 3 * F.char_length(text), "D": text.rlike("[#$%&*|]")}


def failures(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Counts (n, good, toxic) of documents by part and mask of failed filters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = [F.when(failed, F.lit(1 << FILTERS.index(f))).otherwise(F.lit(0)) for f, failed in text_failures(text).items()]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sha"), mask.alias("mask"))
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    marked = marked.where("good or toxic")
    slim = stage(slim, "failures")
    no = F.lit(False)
    known = slim.where("id is not null").join(marked, "id", "left").select("id", "part", "sha", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    # Rows that repeat become one with a count here, where they lie together by id already.
    kind = ["sha", "part", "mask", "good", "toxic"]
    known = known.groupBy("id", *kind).agg(F.count(F.lit(1)).alias("n"))
    unknown = slim.where("id is null").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))

    # A text's rows are few from here on: one a part and label, however many copies there are.
    groups = known.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("least"))
    groups = groups.withColumn("smallest", F.min("least.id").over(Window.partitionBy("sha")))
    firsts = F.when(F.col("least.id") == F.col("smallest"), F.col("least.n")).otherwise(F.lit(0))
    repeats = F.lit(1 << FILTERS.index("E"))
    split = F.explode(F.array(F.struct(firsts.alias("n"), F.col("mask").alias("mask")), F.struct((F.col("n") - firsts).alias("n"), F.col("mask").bitwiseOR(repeats).alias("mask"))))
    rows = groups.select("part", "good", "toxic", split.alias("s")).where("s.n > 0").select("part", "s.mask", "s.n", (F.col("s.n") * F.col("good").cast("long")).alias("good"), (F.col("s.n") * F.col("toxic").cast("long")).alias("toxic"))
    return rows.unionByName(unknown).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def with_survivors(parts: DataFrame, counts: str, to: str, filters: int) -> DataFrame:
    """Adds ``to``: how many documents pass each subset of the filters, from an array of counts by mask.

    The zeta transform sums over all subsets of each index, one bit a step; each step is a column of its own
    and so is computed once. A document passes a subset if its mask lies in the complement: the sums are
    read from the far end.
    """

    def added(step: int) -> Column:
        lower = lambda i: F.when(i.bitwiseAND(F.lit(step)) != 0, F.get(F.col(to), i.bitwiseXOR(F.lit(step)))).otherwise(F.lit(0))
        return F.transform(to, lambda v, i: v + lower(i))

    parts = parts.withColumn(to, F.col(counts))
    for bit in range(filters):
        parts = parts.withColumn(to, added(1 << bit))
    return parts.withColumn(to, F.reverse(to))


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from counts (n, good, toxic) by part and mask."""
    masks = F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))

    def by_mask(c: str) -> Column:
        return F.transform(masks, lambda m: F.coalesce(F.try_element_at(F.col("kinds"), m)[c], F.lit(0)).cast("long"))

    # At most one row a mask is gathered for a part.
    parts = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("kinds"))
    for c in ("n", "good", "toxic"):
        parts = with_survivors(parts.withColumn(f"by_{c}", by_mask(c)), f"by_{c}", f"left_{c}", len(filters))
    rows = parts.select("part", "by_n", "left_n", "left_good", "left_toxic", F.explode(F.array(*(F.lit("".join(p)) for p in permutations(filters)))).alias("filter_order"))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    bit_at = f"shiftleft(1, instr('{filters}', substring(filter_order, %s, 1)) - 1)"
    rows = rows.withColumn("bit", F.expr(bit_at % "step")).withColumn("before", F.expr(f"aggregate(filter(sequence(1, {len(filters)}), i -> i < step), 0, (m, i) -> m | {bit_at % 'i'})"))
    left = lambda c, subset: F.get(F.col(f"left_{c}"), subset)
    after = F.col("before").bitwiseOR(F.col("bit"))
    lost = {c: left(c, F.col("before")) - left(c, after) for c in ("n", "good", "toxic")}
    failing = left("n", F.lit(0)) - left("n", F.col("bit"))
    shown = rows.select(
        "part", "filter_order", "step", "bit", left("n", after).alias("kept"), lost["n"].alias("removed"), (failing - lost["n"]).alias("redundant"),
        F.get("by_n", F.col("bit")).alias("unique_fails"), lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"),
    )
    return shown.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")
