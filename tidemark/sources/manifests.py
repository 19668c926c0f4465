"""Dependencies that manifests name: (path, ecosystem, package, version), as column expressions.

Each manifest is a row of path and content; the lines or keys of all manifests are read in one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import name_of


def dependencies(files: DataFrame) -> DataFrame:
    """Rows of package.json, requirements*.txt, pyproject.toml, go.mod, Cargo.toml, composer.json and Gemfile; other files have none."""
    named = files.select("path", "content", name_of(F.col("path")).alias("name"))
    return reduce(lambda a, b: a.unionByName(b), [read(named) for read in (_npm, _pip, _go, _cargo, _pyproject, _composer, _gemfile)])


def _npm(files: DataFrame) -> DataFrame:
    both = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    rows = files.where("name = 'package.json'").select("path", both.alias("j"))
    empty = F.create_map().cast("map<string,string>")
    each = F.explode(F.concat(F.map_entries(F.coalesce("j.dependencies", empty)), F.map_entries(F.coalesce("j.devDependencies", empty))))
    return rows.select("path", each.alias("e")).select("path", F.lit("npm").alias("ecosystem"), F.col("e.key").alias("package"), F.regexp_replace("e.value", r"^[\^~>=<\s]+", "").alias("version"))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("at", "line"))


def _pip(files: DataFrame) -> DataFrame:
    shape = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(?:[=~><!]=?=?\s*([^\s;,#]+))?"
    rows = _lines(files.where(F.col("name").rlike(r"^requirements.*\.txt$"))).where(~F.col("line").rlike(r"^\s*(#|-|$)"))
    return rows.select("path", F.lit("pip").alias("ecosystem"), F.lower(F.regexp_extract("line", shape, 1)).alias("package"), F.regexp_extract("line", shape, 2).alias("version")).where("package <> ''")


def _go(files: DataFrame) -> DataFrame:
    shape = r"^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+(v\S+)"
    return _lines(files.where("name = 'go.mod'")).select("path", F.lit("go").alias("ecosystem"), F.regexp_extract("line", shape, 1).alias("package"), F.regexp_extract("line", shape, 2).alias("version")).where("package <> ''")


def _cargo(files: DataFrame) -> DataFrame:
    # Sections of dependencies, up to the next heading.
    sections = F.explode(F.regexp_extract_all(F.concat("content", F.lit("\n[")), F.lit(r"(?s)\[(?:dev-|build-)?dependencies\]\s*\n(.*?)(?=\n\[)"), F.lit(1)))
    rows = files.where("name = 'Cargo.toml'").select("path", sections.alias("content"))
    shape = r"""^\s*([A-Za-z0-9_-]+)\s*=\s*(?:"([^"]+)"|\{.*?version\s*=\s*"([^"]+)")"""
    version = F.coalesce(F.nullif(F.regexp_extract("line", shape, 2), F.lit("")), F.regexp_extract("line", shape, 3))
    return _lines(rows).select("path", F.lit("cargo").alias("ecosystem"), F.regexp_extract("line", shape, 1).alias("package"), version.alias("version")).where("package <> ''")


def _pyproject(files: DataFrame) -> DataFrame:
    # Strings of the project's dependency lists, and names of poetry's sections.
    texts = files.where("name = 'pyproject.toml'")
    lists = F.explode(F.regexp_extract_all("content", F.lit(r"(?s)\n(?:dependencies|[\w-]+)\s*=\s*\[(.*?)\n?\]"), F.lit(1)))
    strings = texts.select("path", lists.alias("l")).select("path", F.explode(F.regexp_extract_all("l", F.lit(r"""["']([A-Za-z0-9][^"']*)["']"""), F.lit(1))).alias("line"))
    shape = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(?:[=~><!]=?=?\s*([^\s;,]+))?"
    listed = strings.select("path", F.lit("pip").alias("ecosystem"), F.lower(F.regexp_extract("line", shape, 1)).alias("package"), F.regexp_extract("line", shape, 2).alias("version"))
    sections = F.explode(F.regexp_extract_all(F.concat("content", F.lit("\n[")), F.lit(r"(?s)\[tool\.poetry\.(?:[\w.-]+\.)?dependencies\]\s*\n(.*?)(?=\n\[)"), F.lit(1)))
    pair = r"""^\s*([A-Za-z0-9._-]+)\s*=\s*(?:["']([^"']+)["']|\{.*?version\s*=\s*["']([^"']+)["'])"""
    version = F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract("line", pair, 2), F.lit("")), F.regexp_extract("line", pair, 3)), r"^[\^~>=<\s]+", "")
    poetry = _lines(texts.select("path", sections.alias("content"))).select("path", F.lit("pip").alias("ecosystem"), F.lower(F.regexp_extract("line", pair, 1)).alias("package"), version.alias("version"))
    return listed.unionByName(poetry).where("package not in ('', 'python')")


def _composer(files: DataFrame) -> DataFrame:
    both = F.from_json("content", "require map<string,string>, `require-dev` map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    rows = files.where("name = 'composer.json'").select("path", both.alias("j"))
    each = F.explode(F.concat(F.map_entries(F.coalesce("j.require", empty)), F.map_entries(F.coalesce(F.col("j").getField("require-dev"), empty))))
    return rows.select("path", each.alias("e")).select("path", F.lit("composer").alias("ecosystem"), F.col("e.key").alias("package"), F.regexp_replace("e.value", r"^[\^~>=<\s]+", "").alias("version")).where("package <> 'php'")


def _gemfile(files: DataFrame) -> DataFrame:
    shape = r"""^\s*gem\s+["']([^"']+)["'](?:\s*,\s*["'][~><=\s]*([^"']+)["'])?"""
    return _lines(files.where("name = 'Gemfile'")).select("path", F.lit("gem").alias("ecosystem"), F.regexp_extract("line", shape, 1).alias("package"), F.regexp_extract("line", shape, 2).alias("version")).where("package <> ''")


def drifting(deps: DataFrame, most: int = 10) -> DataFrame:
    """Packages that manifests want in more than one version."""
    g = deps.where("version <> ''").groupBy("ecosystem", "package").agg(F.array_sort(F.collect_set("version")).alias("versions"))
    return g.where(F.size("versions") > 1).withColumn("versions", F.slice("versions", 1, most))
