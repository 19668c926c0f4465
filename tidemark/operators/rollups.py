"""Profiles, trends, ratios and diffs of snapshots."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.paths import endpoint, language
from tidemark.operators.windows import log
from tidemark.operators.windows import ENTRIES_SQL
from tidemark.plans.folds import fold_groups
from tidemark.plans.tables import table


def value_profile(spark, sf_dir):
    """Per type: count, sum, p50 and p95 by index, the most frequent user (the smallest at ties), last event."""
    e = log(spark, sf_dir)
    sums = e.groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.max_by("event_id", F.struct("us", "event_id")).alias("last_event"))
    users = e.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("c"))
    modes = users.groupBy("event_type").agg(F.min_by("user_id", F.struct((-F.col("c")).alias("c"), "user_id")).alias("mode_user"))
    shares = indexed_percentile(e, "event_type", "value", [0.5, 0.95]).select("event_type", "n", "p50", "p95")
    return shares.join(sums, "event_type").join(modes, "event_type")


def indexed_percentile(df: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """Values at index int(n * share) of each group, by counts of distinct values: no group is gathered."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(key).orderBy(value))
    n = F.sum("c").over(Window.partitionBy(key))
    ranked = counts.withColumn("upto", upto).withColumn("n", n)
    picks = [F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * s), F.col("n") - 1), F.col(value))).alias(f"p{int(s * 100)}") for s in shares]
    return ranked.groupBy(key).agg(F.max("n").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), *picks)


def latency_report(spark, sf_dir):
    """Load-test report over events: extremes and percentiles by index."""
    return indexed_percentile(log(spark, sf_dir), "event_type", "value", [0.5, 0.9, 0.95, 0.99])


def daily_trend(spark, sf_dir):
    """Counts a day in fixed buckets of type."""
    e = log(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return e.agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in ("error", "click", "purchase", "signup", "view")], F.max("value").alias("highest"))


def trend_direction(spark, sf_dir):
    d = log(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("status") >= 500).alias("errors"))
    before = F.lag("errors").over(Window.orderBy("day"))  # a row a day
    d = d.withColumn("before", before)
    return d.select("day", "errors", F.when(F.col("before").isNull(), "first").when(F.col("errors") < F.col("before"), "improving").when(F.col("errors") > F.col("before"), "regressing").otherwise("stable").alias("trend"))


def metric_series(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k is not null and k >= 90")


def flaky_users(spark, sf_dir):
    """Users with errors and successes: runs, failures, the newest result, quarantine from half on."""
    e = log(spark, sf_dir).withColumn("failed", (F.col("status") >= 500).cast("long"))
    g = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.sum("failed").alias("failures"), F.max_by("failed", F.struct("us", "event_id")).alias("newest"))
    return g.where("runs >= 5 and failures > 0 and failures < runs").withColumn("quarantined", F.col("failures") * 2 >= F.col("runs"))


def cost_by_model(spark, sf_dir):
    """First rate whose name the type contains; cost is tokens over a thousand times the rate."""
    rates = [("err", 0.5), ("click", 0.1), ("c", 0.2)]
    t = F.col("event_type")
    rate = F.lit(0.01)
    for name, r in reversed(rates):
        rate = F.when(t.contains(name), r).otherwise(rate)
    return log(spark, sf_dir).groupBy("event_type").agg(F.round(F.sum(F.col("value") / 1000 * rate), 6).alias("cost"))


def budget_status(spark, sf_dir):
    d = log(spark, sf_dir).groupBy("user_id").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    share = F.col("cents") / 250_000
    return d.select("user_id", "cents", F.when(share >= 1, "exceeded").when(share >= 0.9, "critical").when(share >= 0.75, "warning").otherwise("ok").alias("state"))


def assurance_verdicts(spark, sf_dir):
    """Claims are orders, evidence their lines: any refuting one disproves, else any supporting one proves."""
    orders, lineitem = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    e = lineitem.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("refuted"), F.bool_or(F.col("l_returnflag") == "A").alias("supported"))
    c = orders.join(e, orders["o_orderkey"] == e["l_orderkey"], "left")
    verdict = F.when(F.col("refuted"), "disproved").when(F.col("supported"), "proved").otherwise("unproven")
    return c.groupBy(F.col("o_orderpriority").alias("domain"), verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def compliance_posture(spark, sf_dir):
    """Every nation is a control; suppliers in debt fail it, none leaves it pending."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    s = supplier.groupBy("s_nationkey").agg(F.count_if(F.col("s_acctbal") < 0).alias("failures"))
    c = nation.join(s, nation["n_nationkey"] == s["s_nationkey"], "left").select("n_regionkey", F.when(F.col("failures").isNull(), "pending").when(F.col("failures") > 0, "fail").otherwise("pass").alias("state"))
    g = c.groupBy("n_regionkey").agg(*[F.count_if(F.col("state") == x).alias(f"n_{x}") for x in ("pass", "fail", "pending")])
    return g.withColumn("posture_pct", F.round(100.0 * F.col("n_pass") / F.nullif(F.col("n_pass") + F.col("n_fail"), F.lit(0)), 4))


def health(components: dict[str, tuple], least: float = 0.0, most: float = 100.0):
    """(score, grade) of weighted components (weight, value), clamped and rounded down."""
    total = sum((weight * value for weight, value in components.values()), F.lit(0.0))
    score = F.floor(F.greatest(F.lit(least), F.least(F.lit(most), total))).cast("long")
    return score, F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def health_score(spark, sf_dir):
    """A segment's health: security with capped deductions, and four shares of its customers."""
    c = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(when).alias(name) for name, when in (("debt", F.col("c_acctbal") < 0), ("rich", F.col("c_acctbal") > 5000), ("used", F.col("c_acctbal") > 500), ("near", F.col("c_nationkey") < 20), ("even", F.col("c_custkey") % 2 == 0))])
    share = lambda name: 100.0 * F.col(name) / F.col("n")
    score, grade = health({"security": (0.35, 100.0 - F.least(F.col("debt") * 0.5, F.lit(60.0))), "coverage": (0.25, share("rich")), "dead code": (0.2, share("used")), "dependencies": (0.1, share("near")), "contracts": (0.1, share("even"))})
    return c.select("c_mktsegment", score.alias("score"), grade.alias("grade"))


def recency_weights(spark, sf_dir):
    """Exponentially weighted accept and reject sums with a half life of about 30 days; skip noisy types."""
    age = (F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_timestamp("ts")) / 86400.0
    e = log(spark, sf_dir).withColumn("w", F.exp(-0.693 * age / 30))
    g = e.groupBy("event_type").agg(F.round(F.sum(F.when(F.col("value") < 30, F.col("w"))), 4).alias("accepted"), F.round(F.sum(F.when(F.col("value") >= 30, F.col("w"))), 4).alias("rejected"))
    return g.withColumn("skip", F.col("rejected") > 3 * F.col("accepted"))


def version_drift(spark, sf_dir):
    """Part names of one kind that come in more than one size, the first ten sizes."""
    p = table(spark, sf_dir, "part").groupBy("p_name", "p_type").agg(F.array_sort(F.collect_set("p_size")).alias("sizes"))
    return p.where(F.size("sizes") > 1).select("p_name", "p_type", F.size("sizes").cast("long").alias("versions"), F.array_join(F.slice("sizes", 1, 10), ",").alias("first_versions"))


def scorecard(spark, sf_dir):
    """Labels against a length rule: recall, clean false positives, by source."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("flagged", F.col("n_chars") < 400)
    g = d.groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("planted"), F.count_if((F.col("quality") == 0) & F.col("flagged")).alias("detected"), F.count_if((F.col("quality") == 1) & F.col("flagged")).alias("false_positives"))
    return g.withColumn("detection_rate", F.round(F.col("detected") / F.nullif(F.col("planted"), F.lit(0)), 6))


def endpoint_usage(spark, sf_dir):
    """Calls by normalised endpoint and method."""
    path = F.regexp_extract("url", "://[^/?#]*(.*)$", 1)
    return table(spark, sf_dir, "pages").groupBy(endpoint(path).alias("endpoint")).agg(F.count(F.lit(1)).alias("calls"))


ENDPOINT_SQL = r"""with p as (select list_filter(string_split(split_part(split_part(regexp_extract(url, '://[^/?#]*(.*)$', 1), '?', 1), '#', 1), '/'), lambda x: x not in ('', '.', '..')) as s from pages)
select '/' || array_to_string(list_transform(s, lambda x: case when regexp_full_match(x, '[0-9]+|[0-9a-f]{8,}') then ':param' else regexp_replace(x, ':\w+|\{\w+\}|\[\w+\]', ':param', 'g') end), '/') as endpoint, count(*) as calls from p group by 1"""


def file_languages(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, ["py", "go", "rs", "md", "xyz", "TS", ""])), (F.col("doc_id") % 7 + 1).cast("int"))
    path = F.concat("source", F.lit("/f"), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))
    return table(spark, sf_dir, "documents").groupBy(language(path).alias("language")).agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"))


def snapshot_changes(spark, sf_dir):
    """Two snapshots of orders (by parity of the customer): prices added, removed, changed, by month."""
    o = table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    snap = lambda k: o.where(f"o_custkey % 2 = {k}").groupBy("month", "o_orderpriority").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias(f"c{k}"))
    both = snap(0).join(snap(1), ["month", "o_orderpriority"], "full_outer")
    change = F.when(F.col("c0").isNull(), "added").when(F.col("c1").isNull(), "removed").when(F.col("c0") != F.col("c1"), "changed").otherwise("unchanged")
    return both.select("month", "o_orderpriority", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("c0", "c1")], change.alias("change"))


def content_drift(spark, sf_dir):
    """Each document against the one with the id before, by content hash: new, unchanged, changed."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    before = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("h").alias("old"))
    return d.join(before, "doc_id", "left").groupBy((F.when(F.col("old").isNull(), "new").when(F.col("h") == F.col("old"), "unchanged").otherwise("changed")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def scope_sets(spark, sf_dir):
    """Sets of types by user in two halves of the month: gained and lost."""
    e = log(spark, sf_dir).withColumn("late", F.dayofmonth("ts") > 15)
    g = e.groupBy("user_id").agg(F.collect_set(F.when(~F.col("late"), F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("late"), F.col("event_type"))).alias("b"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return g.select("user_id", text(F.array_except("b", "a")).alias("gained"), text(F.array_except("a", "b")).alias("lost"), F.size(F.array_intersect("a", "b")).cast("long").alias("common"))


def chain_heads(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Length and last hash of each key's audit chain: every entry's hash covers the one before."""

    def step(state, *values):
        n, head = state
        return n + 1, hashlib.sha256((head + "".join(map(str, values))).encode()).hexdigest()

    return fold_groups(rows, keys, order, values, lambda: (0, ""), step, lambda s: [s], "n long, head string")


def hash_chain(spark, sf_dir):
    return chain_heads(log(spark, sf_dir), ["user_id"], ["event_id"], ["event_id", "event_type"])


CHAIN_SQL = f"""with recursive {ENTRIES_SQL}, o as (select user_id, event_id || event_type as t, row_number() over (partition by user_id order by event_id) as r from entries),
w as (select user_id, r, sha256(t) as h from o where r = 1 union all select o.user_id, o.r, sha256(w.h || o.t) from w join o on o.user_id = w.user_id and o.r = w.r + 1)
select user_id, r as n, h as head from w qualify row_number() over (partition by user_id order by r desc) = 1"""


def _q(body: str) -> str:
    return f"with {ENTRIES_SQL} {body}"


_P = lambda s: f"list_sort(list(value))[least(floor(count(*) * {s}::double)::bigint, count(*) - 1) + 1]"
QUERIES = {
    "value_profile": (value_profile, _q(f"select event_type, count(*) as n, round(sum(value), 4) as total, {_P(0.5)} as p50, {_P(0.95)} as p95, arg_max(event_id, (us, event_id)) as last_event, (select user_id from entries x where x.event_type = entries.event_type group by user_id order by count(*) desc, user_id limit 1) as mode_user from entries group by event_type")),
    "latency_report": (latency_report, _q(f"select event_type, count(*) as n, min(value) as least, max(value) as most, {_P(0.5)} as p50, {_P(0.9)} as p90, {_P(0.95)} as p95, {_P(0.99)} as p99 from entries group by event_type")),
    "daily_trend": (daily_trend, _q("select strftime(ts, '%Y-%m-%d') as day, " + ", ".join(f"count(*) filter (event_type = '{t}') as {t}" for t in ("error", "click", "purchase", "signup", "view")) + ", max(value) as highest from entries group by 1")),
    "trend_direction": (trend_direction, _q("select day, errors, case when before is null then 'first' when errors < before then 'improving' when errors > before then 'regressing' else 'stable' end as trend from (select *, lag(errors) over (order by day) as before from (select strftime(ts, '%Y-%m-%d') as day, count(*) filter (status >= 500) as errors from entries group by 1))")),
    "metric_series": (metric_series, "select event_id, json_extract_string(props, '$.k')::bigint as k from events where json_extract_string(props, '$.k')::bigint >= 90"),
    "flaky_users": (flaky_users, _q("select *, failures * 2 >= runs as quarantined from (select user_id, count(*) as runs, count(*) filter (status >= 500) as failures, arg_max((status >= 500)::bigint, (us, event_id)) as newest from entries group by user_id) where runs >= 5 and failures > 0 and failures < runs")),
    "cost_by_model": (cost_by_model, _q("select event_type, round(sum(value / 1000 * case when contains(event_type, 'err') then 0.5::double when contains(event_type, 'click') then 0.1::double when contains(event_type, 'c') then 0.2::double else 0.01::double end), 6) as cost from entries group by 1")),
    "budget_status": (budget_status, _q("select user_id, cents, case when cents / 250000 >= 1 then 'exceeded' when cents / 250000 >= 0.9 then 'critical' when cents / 250000 >= 0.75 then 'warning' else 'ok' end as state from (select user_id, sum(round(value * 100)::bigint)::bigint as cents from entries group by user_id)")),
    "assurance_verdicts": (assurance_verdicts, "with e as (select l_orderkey, bool_or(l_returnflag = 'R') as refuted, bool_or(l_returnflag = 'A') as supported from lineitem group by 1) select o_orderpriority as domain, case when refuted then 'disproved' when supported then 'proved' else 'unproven' end as verdict, count(*) as n from orders left join e on o_orderkey = l_orderkey group by 1, 2"),
    "compliance_posture": (compliance_posture, "with s as (select s_nationkey, count(*) filter (s_acctbal < 0) as failures from supplier group by 1), c as (select n_regionkey, case when failures is null then 'pending' when failures > 0 then 'fail' else 'pass' end as state from nation left join s on n_nationkey = s_nationkey), g as (select n_regionkey, count(*) filter (state = 'pass') as n_pass, count(*) filter (state = 'fail') as n_fail, count(*) filter (state = 'pending') as n_pending from c group by 1) select *, round(100.0::double * n_pass / nullif(n_pass + n_fail, 0), 4) as posture_pct from g"),
    "health_score": (health_score, "with g as (select c_mktsegment, count(*)::double as n, count(*) filter (c_acctbal < 0) as debt, count(*) filter (c_acctbal > 5000) as rich, count(*) filter (c_acctbal > 500) as used, count(*) filter (c_nationkey < 20) as near, count(*) filter (c_custkey % 2 = 0) as even from customer group by 1), s as (select c_mktsegment, floor(greatest(0.0::double, least(100.0::double, 0.35::double * (100.0::double - least(debt * 0.5::double, 60.0::double)) + 0.25::double * (100.0::double * rich / n) + 0.2::double * (100.0::double * used / n) + 0.1::double * (100.0::double * near / n) + 0.1::double * (100.0::double * even / n))))::bigint as score from g) select *, case when score >= 90 then 'A' when score >= 75 then 'B' when score >= 60 then 'C' when score >= 40 then 'D' else 'F' end as grade from s"),
    "recency_weights": (recency_weights, _q("select *, rejected > 3 * accepted as skip from (select event_type, round(sum(w) filter (value < 30), 4) as accepted, round(sum(w) filter (value >= 30), 4) as rejected from (select *, exp(-0.693::double * ((epoch(timestamp '2024-02-01') - floor(epoch(ts))) / 86400.0::double) / 30) as w from entries) group by event_type)")),
    "version_drift": (version_drift, "select p_name, p_type, len(s) as versions, array_to_string(s[1:10], ',') as first_versions from (select p_name, p_type, list_sort(list_distinct(list(p_size))) as s from part group by 1, 2) where len(s) > 1"),
    "scorecard": (scorecard, "select *, round(detected / nullif(planted, 0), 6) as detection_rate from (select source, count(*) filter (quality = 0) as planted, count(*) filter (quality = 0 and n_chars < 400) as detected, count(*) filter (quality = 1 and n_chars < 400) as false_positives from documents join labels using (doc_id) group by source)"),
    "endpoint_usage": (endpoint_usage, ENDPOINT_SQL),
    "file_languages": (file_languages, "select case doc_id % 7 when 0 then 'python' when 1 then 'go' when 2 then 'rust' when 3 then 'markdown' when 5 then 'typescript' else 'unknown' end as language, count(*) as files, sum(n_chars)::bigint as chars from documents group by 1"),
    "snapshot_changes": (snapshot_changes, "with o as (select *, strftime(o_orderdate, '%Y-%m') as month from orders), a as (select month, o_orderpriority, sum(round(o_totalprice * 100)::bigint)::bigint as c0 from o where o_custkey % 2 = 0 group by 1, 2), b as (select month, o_orderpriority, sum(round(o_totalprice * 100)::bigint)::bigint as c1 from o where o_custkey % 2 = 1 group by 1, 2) select coalesce(a.month, b.month) as month, coalesce(a.o_orderpriority, b.o_orderpriority) as o_orderpriority, coalesce(c0, -1) as c0, coalesce(c1, -1) as c1, case when c0 is null then 'added' when c1 is null then 'removed' when c0 <> c1 then 'changed' else 'unchanged' end as change from a full join b on a.month = b.month and a.o_orderpriority = b.o_orderpriority"),
    "content_drift": (content_drift, "with d as (select doc_id, sha256(text) as h from documents) select case when b.h is null then 'new' when a.h = b.h then 'unchanged' else 'changed' end as state, count(*) as n from d a left join d b on b.doc_id + 1 = a.doc_id group by 1"),
    "scope_sets": (scope_sets, _q("select user_id, array_to_string(list_sort(list_filter(b, lambda x: not list_contains(a, x))), ',') as gained, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(b, x))), ',') as lost, len(list_filter(a, lambda x: list_contains(b, x))) as common from (select user_id, coalesce(list(distinct event_type) filter (day(ts) <= 15), []) as a, coalesce(list(distinct event_type) filter (day(ts) > 15), []) as b from entries group by user_id)")),
    "hash_chain": (hash_chain, CHAIN_SQL),
}
