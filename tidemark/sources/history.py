"""Version-control history as tables: commits, changed files, and who wrote each line.

The log is text, one record a commit, made by::

    git log -p --reverse --first-parent -M --date=short --format=%x1e%H%x1f%an%x1f%ad%x1f%s%x1f

Spark splits it at the record marks. Blame replays each file's hunks in order with one list in hand, the commit that
wrote each line so far; a hunk passes on the commits of the lines it keeps and gives its own to those it adds. Files
are replayed apart from each other, and a file with a long history costs one ordered pass, not memory.

Defined cases: records without a commit id are skipped; hunks that do not fit (a log that begins in the middle) leave
lines without a commit; binary changes have no lines; a renamed file takes its lines along; deleted files have none.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.plans.folds import fold_groups
from tidemark.plans.staging import stage

RECORD, FIELD = "\x1e", "\x1f"
_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """commit, author, date, summary, patch and seq (the place in the log) of each record of a log."""
    records = spark.read.option("lineSep", RECORD).text(path).withColumn("seq", F.monotonically_increasing_id())
    f = F.split("value", FIELD, 5)
    rows = records.select(F.get(f, 0).alias("commit"), F.get(f, 1).alias("author"), F.get(f, 2).alias("date"), F.get(f, 3).alias("summary"), F.coalesce(F.get(f, 4), F.lit("")).alias("patch"), "seq")
    return rows.where(F.col("commit").rlike("^[0-9a-f]{7,}$"))


def file_patches(commits: DataFrame) -> DataFrame:
    """seq, commit, file, old_file, state (added, deleted, renamed, modified) and hunks of each changed file."""
    each = commits.select("seq", "commit", F.explode(F.split("patch", r"(?m)^diff --git ")).alias("part")).where(F.col("part").startswith("a/"))
    head = F.split("part", r"(?m)^(?=@@ )", 2)
    top = F.get(head, 0)
    said = lambda pattern: F.nullif(F.regexp_extract(top, pattern, 1), F.lit(""))
    old = F.coalesce(said(r"(?m)^rename from (.+)$"), said(r"(?m)^--- a/(.+?)\t?$"), said(r"^a/(.+) b/\1\n"))
    new = F.coalesce(said(r"(?m)^rename to (.+)$"), said(r"(?m)^\+\+\+ b/(.+?)\t?$"), old)
    state = F.when(top.rlike("(?m)^new file mode"), "added").when(top.rlike("(?m)^deleted file mode"), "deleted").when(top.rlike("(?m)^rename to "), "renamed").otherwise("modified")
    return each.select("seq", "commit", new.alias("file"), F.coalesce(old, new).alias("old_file"), state.alias("state"), F.coalesce(F.get(head, 1), F.lit("")).alias("hunks"))


def changed_files(commits: DataFrame, since: str) -> DataFrame:
    """Files that commits after ``since`` changed, with their last state and the number of commits; none if it is unknown."""
    start = commits.where(F.col("commit") == since).agg(F.max("seq")).first()[0]
    rows = file_patches(commits.where(F.lit(False) if start is None else F.col("seq") > start))
    return rows.groupBy("file").agg(F.max_by("state", "seq").alias("state"), F.count(F.lit(1)).alias("commits"))


def churn(commits: DataFrame) -> DataFrame:
    """Commits, authors, lines added and removed of each file, under the names of the time."""
    lines = lambda sign: F.size(F.filter(F.split("hunks", "\n"), lambda x: x.startswith(sign)))
    p = file_patches(commits).join(commits.select("seq", "author"), "seq")
    return p.groupBy("file").agg(F.count(F.lit(1)).alias("commits"), F.countDistinct("author").alias("authors"), F.sum(lines("+")).alias("added"), F.sum(lines("-")).alias("removed"))


def _last_names(patches: DataFrame) -> DataFrame:
    """``patches`` with ``last``: the name that the file has at the end of the log."""
    renames = stage(patches.where("state = 'renamed'").select(F.col("old_file").alias("was"), F.col("file").alias("now"), F.col("seq").alias("at")), "renames")
    out = stage(patches.withColumns({"last": F.col("file"), "known": F.col("seq")}), "names")
    while not renames.isEmpty():
        later = out.join(renames, (F.col("last") == F.col("was")) & (F.col("at") > F.col("known"))).groupBy("file", "seq").agg(F.min(F.struct("at", "now")).alias("next"))
        # A name that is made anew before the rename belongs to another file, which a deletion ended.
        ends = out.where("state = 'deleted'").select(F.col("last").alias("gone"), F.col("seq").alias("end"))
        held = out.join(later, ["file", "seq"]).join(ends, (F.col("last") == F.col("gone")) & (F.col("end") >= F.col("known")) & (F.col("end") < F.col("next.at")), "left_anti")
        moved = stage(held.select("file", "seq", F.col("next.now").alias("to"), F.col("next.at").alias("then")), "moved")
        if moved.isEmpty():
            break
        out = stage(out.join(moved, ["file", "seq"], "left").withColumns({"last": F.coalesce("to", "last"), "known": F.coalesce("then", "known")}).drop("to", "then"), "names")
    return out.drop("known")


def replayed(lines: list, commit: str, state: str, hunks: str) -> list:
    """Commits of a file's lines after one more change."""
    if state == "deleted":
        return []
    if state == "added":
        lines = []
    out, at, rest = [], 0, hunks.split("\n")
    for k, row in enumerate(rest):
        if m := _HUNK.match(row):
            first = max(int(m[1]) - (m[2] != "0"), 0)
            out += lines[at:first] + [None] * (first - max(at, len(lines)))
            at = first
            left, right = int(m[2] or 1), int(m[4] or 1)
            for body in rest[k + 1 :]:
                if left <= 0 and right <= 0:
                    break
                if body.startswith("+"):
                    out.append(commit)
                    right -= 1
                elif body.startswith("-"):
                    at, left = at + 1, left - 1
                elif not body.startswith("\\"):
                    out.append(lines[at] if at < len(lines) else None)
                    at, left, right = at + 1, left - 1, right - 1
    return out + lines[at:]


def blame(commits: DataFrame) -> DataFrame:
    """file, line, commit, author, date and summary of every line at the end of the log."""
    p = _last_names(file_patches(commits))
    found = fold_groups(p, ["last"], ["seq"], ["commit", "state", "hunks"], list, replayed, lambda lines: [(i, c) for i, c in enumerate(lines, 1)], "line int, commit string")
    return found.withColumnRenamed("last", "file").join(commits.select("commit", "author", "date", "summary"), "commit", "left").select("file", "line", "commit", "author", "date", "summary")


def changelog(commits: DataFrame) -> DataFrame:
    """Summaries by day and kind (what stands before a colon: feat, fix, ...), in the order of the log."""
    kind = F.lower(F.regexp_extract("summary", r"^(\w+)(?:\([^)]*\))?!?:", 1))
    w = Window.partitionBy("date", "kind").orderBy("seq")
    return commits.select("date", F.when(kind == "", "other").otherwise(kind).alias("kind"), "summary", "commit", "seq").withColumn("nth", F.row_number().over(w)).drop("seq")
