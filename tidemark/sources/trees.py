"""Source trees as a table of files, and what changed since the last scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.paths import language, name_of, noise

# Fixed values.
SKIPPED = r"(^|/)(\.git|node_modules|\.venv|venv|__pycache__|dist|build|\.tox|target|vendor)(/|$)"


def read_tree(spark: SparkSession, root: str, *, most_bytes: int = 1_000_000, keep_noise: bool = True) -> DataFrame:
    """path (below ``root``), name, language, size, md5, modified and content of the tree's source files.

    Empty and oversize files, skipped folders and files of no known language are left out. Sizes are
    filtered before contents are read. Spark's readers skip names that start with ``_`` or ``.``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(f"length > 0 and length <= {most_bytes}")
    below = F.regexp_replace("path", r"^.*?" + _quoted(root.rstrip("/")) + "/", "")
    out = files.select(below.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    out = out.where(~F.col("path").rlike(SKIPPED)).withColumn("language", language(F.col("path"))).where("language <> 'unknown'")
    if not keep_noise:
        out = out.where(noise(F.col("path")).isNull())
    return out.select("path", name_of(F.col("path")).alias("name"), "language", "size", F.md5("content").alias("md5"), "modified", F.decode("content", "utf-8").alias("content"))


def _quoted(text: str) -> str:
    return "\\Q" + text.split("://")[-1].removeprefix("file:") + "\\E"


def changed(files: DataFrame, before: DataFrame) -> DataFrame:
    """Files that are new or differ by content from ``before`` (path, md5): what a scan must look at again."""
    return files.join(before.select("path", "md5"), ["path", "md5"], "left_anti")


def drift(files: DataFrame, before: DataFrame) -> DataFrame:
    """path and state: added, removed, changed or unchanged."""
    new, old = files.select("path", F.col("md5").alias("new")), before.select("path", F.col("md5").alias("old"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return new.join(old, "path", "full_outer").select("path", state.alias("state"))


def imports(files: DataFrame) -> DataFrame:
    """path and module of every import line of Python and JavaScript files."""
    lines = files.select("path", "language", F.explode(F.split("content", "\n")).alias("line"))
    python = F.coalesce(F.nullif(F.regexp_extract("line", r"^\s*from\s+([\w.]+)\s+import\b", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"^\s*import\s+([\w.]+)", 1), F.lit("")))
    script = F.nullif(F.regexp_extract("line", r"""(?:from|require\()\s*['"]([^'"]+)['"]""", 1), F.lit(""))
    found = F.when(F.col("language") == "python", python).when(F.col("language").isin("javascript", "typescript"), script)
    return lines.select("path", found.alias("module")).where("module is not null").distinct()


def import_edges(files: DataFrame) -> DataFrame:
    """Edges between files of the tree: the first file that a module's path names; imports from outside go."""
    here = F.array_join(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), "/")
    above = F.array_join(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 2, F.lit(0))), "/")
    beside = lambda folder, dots: F.concat_ws("/", F.nullif(folder, F.lit("")), F.substring("module", dots + 2, 10_000))
    base = F.when(F.col("module").startswith("./"), beside(here, 1)).when(F.col("module").startswith("../"), beside(above, 2)).otherwise(F.replace("module", F.lit("."), F.lit("/")))
    wanted = imports(files).withColumn("base", base)
    tried = wanted.select("path", "module", F.posexplode(F.array(F.concat("base", F.lit(".py")), F.concat("base", F.lit(".ts")), F.concat("base", F.lit(".js")))).alias("priority", "dst"))
    hit = tried.join(files.select(F.col("path").alias("dst")), "dst").groupBy("path", "module").agg(F.min(F.struct("priority", "dst")).alias("m"))
    return hit.select(F.col("path").alias("src"), F.col("m.dst").alias("dst")).where("src <> dst").distinct()
