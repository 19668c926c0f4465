"""What a workspace shows of scans and code: filtered history, heat of files and folders, impact of layers, confidence.

Defined cases: scans without a count of a severity have none; files without findings are not hot; unknown churn and
size count as nothing; ties of the heat go by path. Folders are listed with the empty path for the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import severity as sev
from tidemark.operators.graph import closure, reversed_edges

WEIGHTS = {"critical": 100, "high": 10}


def history(scans: DataFrame, *, start: str | None = None, end: str | None = None, severities: list[str] | None = None, tool: str | None = None, sort_by: str = "timestamp", descending: bool = True, most: int = 50) -> DataFrame:
    """Scans (id, ts, tool, findings, health, duration_ms, severities map) between two days, the last one included.

    ``severities``: any of them occurs. ``sort_by``: timestamp, findings, health, duration or severity. Filters come before the limit.
    """
    count = lambda s: F.coalesce(F.try_element_at("severities", F.lit(s)), F.lit(0))
    keys = {"timestamp": F.col("ts"), "findings": F.col("findings"), "health": F.col("health"), "duration": F.col("duration_ms"), "severity": sum((count(s) * w for s, w in WEIGHTS.items()), F.lit(0))}
    if sort_by not in keys:
        raise ValueError(f"sort_by must be one of {', '.join(keys)}")
    rows = scans
    if start:
        rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        rows = rows.where(F.col("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    if severities:
        rows = rows.where(F.exists(F.array(*map(count, severities)), lambda n: n > 0))
    if tool and tool != "all":
        rows = rows.where(F.col("tool") == tool)
    key = keys[sort_by]
    return rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "id").limit(most)


def heat(findings: DataFrame, churn: DataFrame, sizes: DataFrame) -> DataFrame:
    """(file, findings, severity, score): ten points a finding, two a commit of ``churn`` (file, commits), one ten KB of ``sizes`` (file, bytes)."""
    f = findings.where("file is not null and file <> ''").groupBy("file").agg(F.count(F.lit(1)).alias("findings"), F.min(sev.rank(F.col("severity"))).alias("_rank"))
    j = f.join(churn.select("file", "commits"), "file", "left").join(sizes.select("file", "bytes"), "file", "left")
    score = F.col("findings") * 10 + F.coalesce("commits", F.lit(0)) * 2 + F.coalesce("bytes", F.lit(0)) / 10_240
    return j.select("file", "findings", F.element_at(F.array(*map(F.lit, sev.NAMES)), F.col("_rank") + 1).alias("severity"), F.round(score, 1).alias("score"))


def folder_heat(files: DataFrame) -> DataFrame:
    """(folder, files, findings, score) of every folder above hot files: each file counts in all of them."""
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = files.select(F.explode(above).alias("folder"), "findings", "score")
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("findings").alias("findings"), F.round(F.sum("score"), 1).alias("score"))


def hotspots(files: DataFrame, most: int = 20) -> DataFrame:
    return files.orderBy(F.desc("score"), "file").limit(most).select("file", "score", "severity")


def layer_impact(layers: DataFrame, depends: DataFrame, changed: DataFrame) -> DataFrame:
    """(layer, state): layers (layer, file) of ``changed`` files are affected; what depends on one (src on dst), however far, is impacted."""
    hit = layers.join(changed.select("file"), "file", "left_semi").select("layer").distinct()
    known = layers.select("layer").distinct()
    links = reversed_edges(depends).join(known.withColumnRenamed("layer", "dst"), "dst", "left_semi").join(known.withColumnRenamed("layer", "src"), "src", "left_semi")
    reached = closure(links, seeds=hit.withColumnRenamed("layer", "src")).select(F.col("dst").alias("layer")).distinct()
    return hit.withColumn("state", F.lit("affected")).unionByName(reached.join(hit, "layer", "left_anti").withColumn("state", F.lit("impacted")))


def change_confidence(certainty: Column, parse_errors: Column, covered: Column, ambiguous: Column) -> Column:
    """0 to 100: less up to 20 for doubt, 15 for parse errors, 20 without tests, 5 for several readings."""
    off = lambda when, points: F.when(F.coalesce(when, F.lit(False)), points).otherwise(0)
    score = 100 - ((1 - F.coalesce(certainty, F.lit(1.0))) * 20).cast("int") - off(parse_errors, 15) - off(~F.coalesce(covered, F.lit(True)), 20) - off(ambiguous, 5)
    return F.greatest(F.lit(0), F.least(F.lit(100), score))
