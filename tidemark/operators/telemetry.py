"""Load reports, latency series, invariants and what is told to whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import severity as sev
from tidemark.operators.findings import FINDINGS_SQL, findings
from tidemark.operators.rollups import indexed_percentile
from tidemark.operators.windows import ENTRIES_SQL, decayed_scores, log
from tidemark.plans.tables import table


def at_least(severity: Column, level: str) -> Column:
    """Whether a severity is ``level`` or worse."""
    return sev.rank(severity) <= sev.NAMES.index(level)


def subscribed(rows: DataFrame, *, sources: list[str] | None = None, agents: list[str] | None = None, techniques: list[str] | None = None, level: str | None = None) -> DataFrame:
    """Rows that a subscriber wants: all of its tests hold, and a test that it lacks holds always."""
    for col, wanted in (("source", sources), ("agent", agents), ("technique", techniques)):
        if wanted is not None:
            rows = rows.where(F.col(col).isin(*wanted))
    return rows if level is None else rows.where(at_least(F.col("severity"), level))


def load_report(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Count, least, most, mean and values at index int(n * q) of each key, the last one at most."""
    marks = indexed_percentile(rows, key, value, [0.5, 0.9, 0.95, 0.99])
    return marks.join(rows.groupBy(key).agg(F.round(F.avg(value), 6).alias("mean")), key)


def histogram(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def latency_series(rows: DataFrame, ts: str, value: str, width: str = "5 seconds", slide: str | None = None) -> DataFrame:
    """For each window: requests, p50, p95 and p99 by index, share of errors (status from 500 on)."""
    at = F.window(ts, width, slide) if slide else F.window(ts, width)
    w = rows.select(at.alias("w"), F.col(value).alias("value"), (F.col("status") >= 500).cast("double").alias("bad")).select(F.col("w.start").alias("start"), "value", "bad")
    marks = indexed_percentile(w, "start", "value", [0.5, 0.95, 0.99]).select("start", "n", "p50", "p95", "p99")
    return marks.join(w.groupBy("start").agg(F.round(F.avg("bad"), 6).alias("error_share")), "start")


def breaches(series: DataFrame, share: float = 0.05, p99: float = 10.0) -> DataFrame:
    """Windows of a series beyond either limit; 0.1 and 30 seconds mark a breakpoint."""
    return series.where((F.col("error_share") > share) | (F.col("p99") > p99))


def top(rows: DataFrame, score: str, n: int, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc(score), *ties).limit(n)


def technique_hits(matches: DataFrame, rows: DataFrame) -> DataFrame:
    """Rule matches (technique) with the findings (id, message, cwe) that name their technique: one equi-join."""
    named = rows.select("id", F.explode(F.array_distinct(F.concat(F.regexp_extract_all(F.coalesce("message", F.lit("")), F.lit(r"\bT[0-9]{4}(?:\.[0-9]{3})?\b"), F.lit(0)), F.array(F.coalesce("cwe", F.lit("")))))).alias("technique"))
    return matches.join(named.where("technique <> ''"), "technique")


def invariants(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(invariant, violations, holds) of conditions that every row must meet; null does not meet one."""
    counts = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"v{i}") for i, ok in enumerate(checks.values())])
    parts = [F.struct(F.lit(name).alias("invariant"), F.col(f"v{i}").alias("violations"), (F.col(f"v{i}") == 0).alias("holds")) for i, name in enumerate(checks)]
    return counts.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def module_name(path: Column, depth: int = 2) -> Column:
    """The first folders of a path; ``root`` for a file without one."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, "root").otherwise(F.array_join(F.slice(parts, 1, F.least(F.lit(depth), F.size(parts) - 1)), "."))


def coverage_facts(reports: DataFrame, col: str = "value") -> DataFrame:
    """(file, covered, lines, share) out of JSON coverage reports: files with executed and missing lines."""
    shape = "files map<string, struct<executed_lines: array<int>, missing_lines: array<int>>>"
    each = reports.select(F.from_json(col, shape).alias("r")).select(F.explode("r.files").alias("file", "f"))
    covered, missing = F.coalesce(F.size("f.executed_lines"), F.lit(0)), F.coalesce(F.size("f.missing_lines"), F.lit(0))
    return each.select("file", covered.alias("covered"), (covered + missing).alias("lines")).withColumn("share", F.round(F.col("covered") / F.nullif(F.col("lines"), F.lit(0)), 4))


def newest_first(audit: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """The last ``n`` entries of a log."""
    return audit.orderBy(F.desc(order)).limit(n)


def tracker_rows(rows: DataFrame) -> DataFrame:
    """Findings as a vulnerability tracker takes them: title, severity with a capital, place, weakness as a number."""
    return rows.select(F.concat_ws(" in ", "type", "file").alias("title"), F.initcap("severity").alias("severity"), F.col("file").alias("file_path"), "line", F.nullif(F.regexp_extract("cwe", "([0-9]+)$", 1), F.lit("")).cast("int").alias("cwe"), F.col("message").alias("description"))


def agent_summary(profiles: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(slowest by p95, least accurate) of profiles (agent, p95, runs, right); fewer than three runs count as half right."""
    accuracy = F.when(F.col("runs") < 3, 0.5).otherwise(F.col("right") / F.col("runs"))
    p = profiles.withColumn("accuracy", F.round(accuracy, 6))
    return p.orderBy(F.desc("p95"), "agent").limit(n), p.orderBy("accuracy", "agent").limit(n)


# --- registered queries ---------------------------------------------------------------------------


def load_by_method(spark, sf_dir):
    return load_report(log(spark, sf_dir), "method", "value")


def status_histogram(spark, sf_dir):
    return histogram(log(spark, sf_dir), "method", "status")


def latency_windows(spark, sf_dir):
    s = latency_series(log(spark, sf_dir), "ts", "value", "6 hours")
    return s.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "p50", "p95", "p99", "error_share")


def latency_breaches(spark, sf_dir):
    s = breaches(latency_series(log(spark, sf_dir), "ts", "value", "6 hours"), 0.25, 90.0)
    return s.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "p99", "error_share")


def top_watched(spark, sf_dir):
    """The ten highest decayed scores."""
    e = log(spark, sf_dir).where("status >= 400").withColumn("points", F.lit(10.0))
    s = decayed_scores(e, ["ip"], ["us", "event_id"], "us", "points", 5 * 86_400_000_000).select("ip", F.round("score", 6).alias("score"))
    return top(s, "score", 10, "ip")


def top_threats(spark, sf_dir):
    e = log(spark, sf_dir).where("status >= 400").groupBy("ip").agg(F.countDistinct("path").alias("lists_hit"))
    return top(e, "lists_hit", 10, "ip")


def technique_matches(spark, sf_dir):
    """Findings by weakness as techniques, and a message that names one."""
    rows = findings(spark, sf_dir).select(F.concat_ws(":", "file", "line", "type").alias("id"), F.when(F.col("type") == "phone", "see T1078 and T1078").otherwise("").alias("message"), "cwe")
    matches = spark.createDataFrame([("R1", "T1078"), ("R2", "CWE-798"), ("R3", "T9999")], "rule string, technique string")
    return technique_hits(matches, rows).groupBy("rule", "technique").agg(F.count(F.lit(1)).alias("n"))


def order_invariants(spark, sf_dir):
    checks = {"price is positive": F.col("o_totalprice") > 0, "cheap": F.col("o_totalprice") < 100_000, "has a customer": F.col("o_custkey").isNotNull()}
    return invariants(table(spark, sf_dir, "orders"), checks)


def urgent_findings(spark, sf_dir):
    return subscribed(findings(spark, sf_dir), agents=["pii", "secrets"], level="high").groupBy("agent", "severity").agg(F.count(F.lit(1)).alias("n"))


def tracker_export(spark, sf_dir):
    return tracker_rows(findings(spark, sf_dir)).groupBy("severity", "cwe").agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("first_title"))


def agent_profile(spark, sf_dir):
    """Event types as agents: a run is right where it is no error; the slowest three."""
    e = log(spark, sf_dir)
    runs = e.groupBy(F.col("user_id").alias("agent")).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") < 400).alias("right"))
    marks = indexed_percentile(e, "user_id", "value", [0.95]).select(F.col("user_id").alias("agent"), "p95")
    return agent_summary(runs.join(marks, "agent"), 10)[0].select("agent", "p95", "runs", "accuracy")


def _e(body: str) -> str:
    return f"with {ENTRIES_SQL} {body}"


_P = lambda s: f"list_sort(list(value))[least(floor(count(*) * {s}::double)::bigint, count(*) - 1) + 1]"
_SERIES = f"s as (select strftime(time_bucket(interval '6 hours', ts, timestamp '2024-01-01'), '%Y-%m-%d %H:%M:%S') as start, count(*) as n, {_P(0.5)} as p50, {_P(0.95)} as p95, {_P(0.99)} as p99, round(avg((status >= 500)::int::double), 6) as error_share from entries group by 1)"
_WATCH = """o as (select ip, us, row_number() over (partition by ip order by us, event_id) as r from entries where status >= 400),
w as (select ip, r, us, 10.0::double as score from o where r = 1 union all select o.ip, o.r, o.us, w.score * greatest(0.0::double, 1.0::double - (o.us - w.us) / 432000000000.0::double) + 10 from w join o on o.ip = w.ip and o.r = w.r + 1)"""
QUERIES = {
    "load_by_method": (load_by_method, _e(f"select method, count(*) as n, min(value) as least, max(value) as most, {_P(0.5)} as p50, {_P(0.9)} as p90, {_P(0.95)} as p95, {_P(0.99)} as p99, round(avg(value), 6) as mean from entries group by method")),
    "status_histogram": (status_histogram, _e("select method, status, count(*) as n from entries group by all")),
    "latency_windows": (latency_windows, _e(f", {_SERIES} select * from s").replace("from events) ,", "from events),")),
    "latency_breaches": (latency_breaches, _e(f", {_SERIES} select start, p99, error_share from s where error_share > 0.25 or p99 > 90").replace("from events) ,", "from events),")),
    "top_watched": (top_watched, f"with recursive {ENTRIES_SQL}, {_WATCH} select ip, round(score, 6) as score from w qualify row_number() over (partition by ip order by r desc) = 1 order by round(score, 6) desc, ip limit 10"),
    "top_threats": (top_threats, _e("select ip, count(distinct path) as lists_hit from entries where status >= 400 group by ip order by 2 desc, 1 limit 10")),
    "technique_matches": (technique_matches, f"with {FINDINGS_SQL} select 'R1' as rule, 'T1078' as technique, count(*) as n from findings where type = 'phone' having count(*) > 0 union all select 'R2', 'CWE-798', count(*) from findings where cwe = 'CWE-798' having count(*) > 0"),
    "order_invariants": (order_invariants, "select 'price is positive' as invariant, count(*) filter (not coalesce(o_totalprice > 0, false)) as violations, violations = 0 as holds from orders union all select 'cheap', count(*) filter (not coalesce(o_totalprice < 100000, false)) as v, v = 0 from orders union all select 'has a customer', count(*) filter (o_custkey is null) as v, v = 0 from orders"),
    "urgent_findings": (urgent_findings, f"with {FINDINGS_SQL} select agent, severity, count(*) as n from findings where agent in ('pii', 'secrets') and severity in ('critical', 'high') group by all"),
    "tracker_export": (tracker_export, f"with {FINDINGS_SQL} select upper(severity[1]) || severity[2:] as severity, split_part(cwe, '-', 2)::int as cwe, count(*) as n, min(type || ' in ' || file) as first_title from findings group by 1, 2"),
    "agent_profile": (agent_profile, _e(f"select user_id as agent, {_P(0.95)} as p95, count(*) as runs, round(case when count(*) < 3 then 0.5 else count(*) filter (status < 400) / count(*) end, 6) as accuracy from entries group by 1 order by p95 desc, agent limit 10")),
}
