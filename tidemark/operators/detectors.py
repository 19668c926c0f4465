"""Detectors as data: registered patterns and functions that turn a table of files into findings.

A detector is either a pattern over lines or a function of files (path, language, content). All patterns run
in one pass over the lines; functions get the files of their languages. ``discover`` imports modules that
register their own, so a project adds detectors without touching this package.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ignores import glob_regex

FINDING = ("agent", "type", "severity", "cwe", "file", "line", "message")


@dataclass(frozen=True)
class Detector:
    """``pattern`` or ``find`` (files -> findings without agent); no languages means all."""

    name: str
    type: str = ""
    severity: str = "medium"
    cwe: str = ""
    pattern: str | None = None
    find: Callable[[DataFrame], DataFrame] | None = None
    languages: tuple[str, ...] = ()
    priority: int = 0


_KNOWN: dict[str, Detector] = {}


def register(detector: Detector) -> Detector:
    _KNOWN[detector.name] = detector
    return detector


def detector(name: str, languages: tuple[str, ...] = (), priority: int = 0) -> Callable:
    """Registers a function of files (path, language, content) that returns type, severity, cwe, file, line, message."""

    def wrap(find: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        register(Detector(name, find=find, languages=languages, priority=priority))
        return find

    return wrap


def registered(names: Iterable[str] | None = None) -> list[Detector]:
    """All detectors, or those named, the highest priority first."""
    chosen = [d for n, d in _KNOWN.items() if names is None or n in set(names)]
    return sorted(chosen, key=lambda d: (-d.priority, d.name))


def discover(modules: Iterable[str]) -> list[str]:
    """Imports modules that register detectors; the names that they added. A module that fails is an error."""
    before = set(_KNOWN)
    for module in modules:
        importlib.import_module(module)
    return sorted(set(_KNOWN) - before)


def in_scope(path: Column, prefixes: Iterable[str] = (), globs: Iterable[str] = ()) -> Column:
    """Whether a path lies below one of the prefixes (none: all) and fits one of the globs (none: all)."""
    inside = [F.lit(True)] if not (p := [x.rstrip("/") for x in prefixes]) else [(path == x) | path.startswith(x + "/") for x in p]
    fits = [F.lit(True)] if not (g := list(globs)) else [path.rlike(glob_regex(x)) for x in g]
    either = lambda tests: reduce(lambda a, b: a | b, tests)
    return either(inside) & either(fits)


def shard(files: DataFrame, index: int, of: int) -> DataFrame:
    """Shard ``index`` of ``of`` by a hash of the path: every file is in exactly one."""
    return files.where(F.pmod(F.xxhash64("path"), F.lit(of)) == index)


def exclusions(files: DataFrame, reason: Column) -> DataFrame:
    """Files by the reason why a scan leaves them out; those it keeps have none."""
    return files.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("files"))


def detect(files: DataFrame, detectors: list[Detector] | None = None) -> DataFrame:
    """Findings of all detectors over ``files`` (path, language, content)."""
    detectors = registered() if detectors is None else detectors
    spoken = lambda d: F.col("language").isin(*d.languages) if d.languages else F.lit(True)
    parts = []
    if patterns := [d for d in detectors if d.pattern]:
        rows = files.select("path", "language", F.posexplode(F.split("content", r"\r?\n")).alias("at", "body"))
        hits = [F.when(spoken(d) & F.col("body").rlike(d.pattern), F.struct(F.lit(d.name).alias("agent"), F.lit(d.type or d.name).alias("type"), F.lit(d.severity).alias("severity"), F.lit(d.cwe).alias("cwe"), F.regexp_extract("body", d.pattern, 0).alias("message"))) for d in patterns]
        found = rows.withColumn("h", F.explode(F.array_compact(F.array(*hits))))
        parts.append(found.select("h.agent", "h.type", "h.severity", "h.cwe", F.col("path").alias("file"), (F.col("at") + 1).cast("long").alias("line"), "h.message"))
    for d in detectors:
        if d.find:
            parts.append(d.find(files.where(spoken(d))).withColumn("agent", F.lit(d.name)).select(*FINDING))
    if not parts:
        raise ValueError("no detectors")
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- built-in detectors and structure -------------------------------------------------------------

register(Detector("eval_call", "code_injection", "high", "CWE-95", r"\b(eval|exec)\s*\(", languages=("python", "javascript", "typescript", "php", "ruby")))
register(Detector("shell_true", "command_injection", "high", "CWE-78", r"subprocess\.\w+\(.*shell\s*=\s*True|os\.system\s*\(", languages=("python",)))
register(Detector("weak_hash", "weak_crypto", "medium", "CWE-327", r"(?i)\b(md5|sha1)\s*\("))
register(Detector("unsafe_yaml", "deserialization", "high", "CWE-502", r"yaml\.load\((?!.*Loader)|pickle\.loads?\(", languages=("python",)))
register(Detector("inner_html", "xss", "medium", "CWE-79", r"\.innerHTML\s*=|dangerouslySetInnerHTML", languages=("javascript", "typescript", "html")))
register(Detector("debug_on", "debug_enabled", "low", "CWE-489", r"(?i)\bdebug\s*[:=]\s*true\b"))

# How frameworks write routes, and clients write calls.
ROUTES = {
    "python": r"@\w+\.(get|post|put|delete|patch|route)\(\s*['\"]([^'\"]+)", "javascript": r"\b(?:app|router)\.(get|post|put|delete|patch)\(\s*['\"`]([^'\"`]+)",
    "typescript": r"\b(?:app|router)\.(get|post|put|delete|patch)\(\s*['\"`]([^'\"`]+)", "go": r"\.(GET|POST|PUT|DELETE|PATCH|HandleFunc)\(\s*\"([^\"]+)", "ruby": r"^\s*(get|post|put|delete|patch)\s+['\"]([^'\"]+)",
}
CALLS = r"(?:fetch|axios(?:\.(get|post|put|delete|patch))?|\$\.(?:ajax|getJSON))\(\s*['\"`]([^'\"`]+)"
SYMBOLS = {
    "python": r"^\s*(?:async\s+)?(def|class)\s+(\w+)", "javascript": r"^\s*(?:export\s+)?(?:async\s+)?(function|class)\s+(\w+)", "typescript": r"^\s*(?:export\s+)?(?:async\s+)?(function|class|interface)\s+(\w+)",
    "go": r"^(func|type)\s+(?:\([^)]*\)\s*)?(\w+)", "rust": r"^\s*(?:pub\s+)?(fn|struct|enum|trait)\s+(\w+)", "java": r"^\s*(?:public|private|protected)?\s*(class|interface|enum)\s+(\w+)", "ruby": r"^\s*(def|class|module)\s+(\w+)",
}


def _by_language(files: DataFrame, shapes: dict[str, str], first: str, second: str) -> DataFrame:
    """Two groups of each language's pattern, for every line that has it."""
    rows = files.where(F.col("language").isin(*shapes)).select("path", "language", F.posexplode(F.split("content", r"\r?\n")).alias("at", "body"))
    group = lambda k: reduce(lambda acc, s: F.when(F.col("language") == s[0], F.regexp_extract("body", s[1], k)).otherwise(acc), shapes.items(), F.lit(""))
    return rows.select(F.col("path").alias("file"), (F.col("at") + 1).cast("long").alias("line"), group(1).alias(first), group(2).alias(second)).where(F.col(second) != "")


def symbols(files: DataFrame) -> DataFrame:
    """(file, line, kind, name) of what files define."""
    return _by_language(files, SYMBOLS, "kind", "name")


def http_method(verb: Column) -> Column:
    """GET unless the verb is another one."""
    v = F.upper(F.coalesce(verb, F.lit("")))
    return F.when(v.isin("POST", "PUT", "DELETE", "PATCH"), v).otherwise("GET")


def routes(files: DataFrame) -> DataFrame:
    """(file, line, method, path) of the routes that files declare."""
    found = _by_language(files, ROUTES, "verb", "path")
    return found.select("file", "line", http_method(F.col("verb")).alias("method"), "path")


def client_calls(files: DataFrame) -> DataFrame:
    """(file, method, path) of the calls that scripts make, each once; the method may stand on the same line."""
    rows = files.where(F.col("language").isin("javascript", "typescript", "html")).select("path", F.explode(F.split("content", r"\r?\n")).alias("body"))
    verb = F.coalesce(F.nullif(F.regexp_extract("body", CALLS, 1), F.lit("")), F.nullif(F.regexp_extract("body", r"method\s*:\s*['\"](\w+)", 1), F.lit("")))
    found = rows.select(F.col("path").alias("file"), http_method(verb).alias("method"), F.regexp_extract("body", CALLS, 2).alias("path"))
    return found.where("path <> ''").distinct()


def orphaned(routes_: DataFrame, calls: DataFrame, normal: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(routes that nothing calls, calls that no route answers) on method and normalised path."""
    r, c = routes_.withColumn("_path", normal(F.col("path"))), calls.withColumn("_path", normal(F.col("path")))
    return r.join(c, ["method", "_path"], "left_anti").drop("_path"), c.join(r, ["method", "_path"], "left_anti").drop("_path")
