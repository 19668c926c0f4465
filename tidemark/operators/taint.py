"""Untrusted values that reach dangerous calls, by reaching definitions over code facts.

A use of a name reads the last assignment of it before, in its own function or else at the top of the file: one
ordered pass a name, no pairs of lines. Taint then spreads along these reads, a written frontier a round: an
assignment is tainted if its value is a source or reads a tainted assignment, unless a sanitizer stands in it.

Defined cases: order is the order of the text, so branches and loops are read once; facts without a scope are at the top
of their file; with ``hops`` 0 only sources themselves count, with None taint spreads until nothing is new.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.plans.staging import stage

# Where untrusted values come from, and what makes them harmless.
SOURCES = (
    "request.args", "request.form", "request.json", "request.data", "request.GET", "request.POST", "request.body", "request.headers", "request.query_params", "request.path_params", "request.cookies",
    "req.query", "req.body", "req.params", "req.headers", "input", "sys.argv", "os.environ", "os.getenv", "self.request", "self.params", "params", "query", "payload", "event.target", "event.data", "document.location", "location.search",
)
WHOLE_SOURCES = ("request", "req", "event", "location")
SANITIZERS = ("escape", "sanitize", "html.escape", "markupsafe.escape", "bleach.clean", "django.utils.html.escape", "parameterized", "prepare", "quote", "urlencode", "encode_for_sql")
SINKS = {
    "command": ("exec", "eval", "execScript", "subprocess.call", "subprocess.Popen", "subprocess.run", "subprocess.check_call", "subprocess.check_output", "os.system", "os.popen", "shell_exec", "system", "passthru", "execSync", "spawnSync"),
    "sql": ("execute", "execute_query", "executeQuery", "executeUpdate", "raw_query", "cursor.execute", "cursor.executemany", "db.execute", "session.execute"),
}


def is_source(text: Column, sources: tuple[str, ...] = SOURCES) -> Column:
    """Whether a value is a source, a member or an item of one, or a call of one."""
    t = F.trim(text)
    starts = reduce(lambda a, b: a | b, (t.startswith(s + mark) for s in sources for mark in ".[("))
    return t.isin(*sources, *WHOLE_SOURCES) | starts


def is_sanitized(text: Column, sanitizers: tuple[str, ...] = SANITIZERS) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(s) for s in sanitizers))


def _reads(uses: DataFrame, assigns: DataFrame) -> DataFrame:
    """(reader, path, def): which assignment each use (path, scope, name, pos, reader) reads."""
    every = uses.select("path", "scope", "name", "pos", "reader", F.lit(None).cast("int").alias("def")).unionByName(assigns.select("path", "scope", "name", "pos", F.lit(None).cast("string").alias("reader"), F.col("pos").alias("def")))
    # Assignments at the top of a file are seen by its functions too.
    order = Window.partitionBy("path", "scope", "name").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    own = every.withColumn("read", F.last("def", ignorenulls=True).over(order)).where("reader is not null")
    top = assigns.where("scope = ''").groupBy("path", "name").agg(F.max("pos").alias("top"))
    return own.join(top, ["path", "name"], "left").select("path", "reader", F.coalesce("read", F.when(F.col("scope") != "", F.col("top"))).alias("def")).where("def is not null")


def tainted_calls(facts: DataFrame, sinks: tuple[str, ...] = SINKS["command"] + SINKS["sql"], *, sources: tuple[str, ...] = SOURCES, sanitizers: tuple[str, ...] = SANITIZERS, hops: int | None = 1) -> DataFrame:
    """path, line, name, text and the tainted arguments (via) of calls to ``sinks``, with the fewest assignments between (hops)."""
    assigns = stage(facts.where("kind = 'assign'").select("path", "scope", "name", "pos", "line", "text", "uses"), "assigns")
    calls = facts.where((F.col("kind") == "call") & (F.col("full").isin(*sinks) | F.col("name").isin(*sinks)))
    args = stage(calls.select("path", "scope", "pos", "line", F.col("full").alias("name"), "text", F.posexplode("args").alias("nth", "arg")).select("*", F.concat_ws("#", "pos", "nth").alias("reader")), "arguments")

    read = assigns.select("path", "scope", F.explode("uses").alias("name"), "pos", F.concat(F.lit("="), "pos").alias("reader"))
    edges = _reads(read, assigns).select("path", F.substring("reader", 2, 20).cast("int").alias("pos"), F.col("def").alias("from"))
    clean = is_sanitized(F.col("text"), sanitizers)
    frontier = found = stage(assigns.where(is_source(F.col("text"), sources) & ~clean).select("path", F.col("pos").alias("def"), F.lit(1).alias("hops")), "tainted")
    spread = stage(edges.join(assigns.where(~clean).select("path", "pos"), ["path", "pos"], "left_semi"), "reads")
    done = 1
    while hops is None or done < hops:
        done += 1
        new = spread.join(frontier.select("path", F.col("def").alias("from")), ["path", "from"]).select("path", F.col("pos").alias("def")).distinct()
        frontier = stage(new.join(found, ["path", "def"], "left_anti").withColumn("hops", F.lit(done)), "tainted")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    if hops == 0:
        found = found.limit(0)
    touched = _reads(args.select("path", "scope", F.explode("arg.uses").alias("name"), "pos", "reader"), assigns).join(found, ["path", "def"]).groupBy("path", "reader").agg(F.min("hops").alias("hops"))
    judged = args.join(touched, ["path", "reader"], "left").withColumn("hops", F.when(is_source(F.col("arg.text"), sources), F.lit(0)).otherwise(F.col("hops")))
    bad = judged.where(F.col("hops").isNotNull() & ~is_sanitized(F.col("arg.text"), sanitizers))
    return bad.groupBy("path", "line", "pos", "name", "text").agg(F.array_sort(F.collect_list("arg.text")).alias("via"), F.min("hops").alias("hops")).drop("pos")
