"""Reports and rankings: filters with top-k, retention, activation, priorities, risk and robust outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.findings import FINDINGS_SQL, findings
from tidemark.operators.windows import ENTRIES_SQL, log, trailing_counts
from tidemark.plans.tables import table


def history_filter(spark, sf_dir):
    """Orders of two priorities in a year (end day included), the most expensive first; filters come before the limit."""
    o = table(spark, sf_dir, "orders").where("o_orderdate >= '1996-01-01' and o_orderdate < '1997-01-01' and o_orderpriority in ('1-URGENT', '2-HIGH')")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority", "o_totalprice")


def retention(spark, sf_dir):
    """The newest three orders of each customer stay."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    o = table(spark, sf_dir, "orders").withColumn("nth", F.row_number().over(w))
    return o.groupBy((F.col("nth") <= 3).alias("stays")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("most"))


def sbom_components(spark, sf_dir):
    """One component of a bill of materials a part, as JSON."""
    p = table(spark, sf_dir, "part")
    purl = F.concat(F.lit("pkg:generic/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("@"), F.col("p_size").cast("string"))
    return p.select("p_partkey", F.to_json(F.struct(F.lit("library").alias("type"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("version"), purl.alias("purl"))).alias("component"))


HOOKS = [("audit", ["*"]), ("pager", ["error"]), ("sales", ["purchase", "signup"]), ("none", ["refund"])]


def webhook_fanout(spark, sf_dir):
    """Deliveries of each hook: those of its event names, or of all."""
    hooks = spark.createDataFrame(HOOKS, "hook string, names array<string>").select("hook", F.explode("names").alias("name"))
    per_type = log(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    sent = per_type.join(F.broadcast(hooks), (F.col("name") == F.col("event_type")) | (F.col("name") == "*"))
    return sent.groupBy("hook").agg(F.sum("n").alias("deliveries"), F.max("last").alias("last_event"))


def domain_activation(spark, sf_dir):
    """Signals of users (types of their events) weigh for domains; from 0.5 a domain is active; errors force it."""
    weights = [("error", "reliability", 0.3), ("error", "security", 0.2), ("purchase", "payments", 0.5), ("signup", "identity", 0.4), ("view", "content", 0.1), ("click", "content", 0.2)]
    w = spark.createDataFrame(weights, "event_type string, domain string, weight double")
    seen = log(spark, sf_dir).where("value > 40").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    s = seen.join(F.broadcast(w), "event_type").groupBy("user_id", "domain").agg(F.round(F.sum(F.col("weight") * F.least("n", F.lit(3))), 6).alias("score"))
    return s.where("score >= 0.5").select("user_id", "domain", F.least("score", F.lit(1.0)).alias("score"))


def test_priorities(spark, sf_dir):
    """Parts by how often they are used, how seldom they come back, and their price; the first 20."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("fan_in"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count(F.lit(1)).alias("used"))
    p = table(spark, sf_dir, "part").join(li, F.col("p_partkey") == F.col("l_partkey"), "left")
    score = 2 * F.coalesce("fan_in", F.lit(0)) + 3 * F.coalesce("returned", F.lit(0)) + F.when(F.col("p_retailprice") > 1000, 5).otherwise(0) - F.least(F.coalesce("used", F.lit(0)), F.lit(10))
    return p.select("p_partkey", score.cast("long").alias("score")).orderBy(F.desc("score"), "p_partkey").limit(20)


def benchmark_cases(spark, sf_dir):
    """Labels as cases: whether a finding of an expected type is in the document; rates by kind."""
    f = findings(spark, sf_dir).where("type in ('email', 'card', 'credential', 'phone')").select("doc_id").distinct().withColumn("hit", F.lit(1))
    c = table(spark, sf_dir, "labels").join(f, "doc_id", "left")
    g = c.groupBy((F.when(F.col("quality") == 0, "vulnerable").otherwise("clean")).alias("kind")).agg(F.count(F.lit(1)).alias("cases"), F.count("hit").alias("hits"))
    return g.withColumn("rate", F.round(F.col("hits") / F.col("cases"), 6))


def cached_lookups(spark, sf_dir):
    """Errors with the user's last signup, if it is not older than three days: a lookup with a time to live."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    last = lambda c: F.last(F.when(F.col("event_type") == "signup", F.col(c)), ignorenulls=True).over(w)
    e = log(spark, sf_dir).withColumn("signup", last("event_id")).withColumn("signup_us", last("us")).where("event_type = 'error'")
    fresh = F.col("us") - F.col("signup_us") <= 3 * 86_400_000_000
    return e.select("event_id", F.when(fresh, F.col("signup")).otherwise(F.lit(-1)).alias("signup"))


def changed_domains(spark, sf_dir):
    """Weights of path and host patterns for domains: the largest a page and domain, from 0.4 on."""
    patterns = [("/en/", "english", 0.6), ("/en", "english", 0.3), ("spam", "abuse", 0.9), ("cheap", "abuse", 0.8), ("casino", "abuse", 0.7), ("?", "queries", 0.4), ("#", "anchors", 0.2)]
    hits = F.filter(F.array(*[F.when(F.col("url").contains(p), F.struct(F.lit(d).alias("domain"), F.lit(w).alias("weight"))) for p, d, w in patterns]), lambda h: h.isNotNull())
    s = table(spark, sf_dir, "pages").select("page_id", F.explode(hits).alias("h")).groupBy("page_id", "h.domain").agg(F.max("h.weight").alias("weight")).where("weight >= 0.4")
    return s.groupBy("domain").agg(F.count(F.lit(1)).alias("pages"), F.max("weight").alias("weight"))


def soak_windows(spark, sf_dir):
    """Trailing six hours of a type with more than 30 % slow events and at least ten of them."""
    rows = log(spark, sf_dir).select("event_id", "event_type", "us", "value")
    e = trailing_counts(rows, "event_type", 6 * 3600, {"n": F.lit(True), "slow": F.col("value") > 35})
    return e.where("n >= 10 and slow * 10 > n * 3").select("event_id", "event_type", "n", "slow")


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, middle): the median of each key, the mean of the two middle values where they are even in number.

    Found from counts of distinct values: no group's values meet in one aggregate.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(key).orderBy(value))
    ranked = counts.withColumn("_upto", upto).withColumn("_n", F.sum("_c").over(Window.partitionBy(key)))
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col(value)))
    return ranked.groupBy(key).agg(((at(F.floor((F.col("_n") - 1) / 2)) + at(F.floor(F.col("_n") / 2))) / 2).alias("middle"))


def robust_outliers(spark, sf_dir):
    """Values more than six median deviations from the median of their type."""
    e = log(spark, sf_dir).select("event_id", "event_type", "value")
    mid = medians(e, "event_type", "value").withColumnRenamed("middle", "median")
    off = e.join(F.broadcast(mid), "event_type").withColumn("off", F.abs(F.col("value") - F.col("median")))  # a row a type
    spread = medians(off, "event_type", "off").withColumnRenamed("middle", "mad")
    return off.join(F.broadcast(spread), "event_type").where("off > 6 * mad").select("event_id", F.round(F.col("off") / F.col("mad"), 6).alias("deviations"))


def change_risk(spark, sf_dir):
    """Risk of an order as a change set: capped terms over its lines, cut at 30 and 60."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("files"), F.sum("l_quantity").alias("size"), F.count_if(F.col("l_discount") > 0.05).alias("risky"), F.bool_or(F.col("l_tax") > 0.07).alias("migration"))
    score = F.least(F.col("files") * 5, F.lit(25)) + F.least(F.floor(F.col("size") / 10), F.lit(25)) + F.least(F.col("risky") * 8, F.lit(30)) + F.when(F.col("migration"), 20).otherwise(0)
    s = li.select("l_orderkey", F.least(score, F.lit(100)).cast("long").alias("risk"))
    return s.groupBy(F.when(F.col("risk") < 30, "low").when(F.col("risk") < 60, "medium").otherwise("high").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("risk").alias("total"))


def bug_prediction(spark, sf_dir):
    """Suppliers by 0.4 churn + 0.1 complexity + 2 past faults, above a cut."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("churn"), F.countDistinct("l_partkey").alias("complexity"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.09)).alias("past"))
    return li.select("l_suppkey", F.round(0.4 * F.col("churn") + 0.1 * F.col("complexity") + 2 * F.col("past"), 4).alias("score")).where("score > 15")


def token_costs(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.floor(F.col("n_chars") * 13 / 10)).alias("tokens"), F.count(F.lit(1)).alias("n"))


def triage_spikes(spark, sf_dir):
    """Values more than three deviations above the mean of the user's 20 values before, from the fifth on."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(-20, -1)
    e = log(spark, sf_dir).select("event_id", "value", F.count(F.lit(1)).over(w).alias("n"), F.avg("value").over(w).alias("mean"), F.stddev_pop("value").over(w).alias("sd"))
    return e.where("n >= 5 and value > mean + 3.0001 * sd").select("event_id", "n")


def severity_pivot(spark, sf_dir):
    """Types against sources as a matrix of counts."""
    f = findings(spark, sf_dir).withColumn("top", F.split("file", "/")[0])
    return f.groupBy("top").pivot("type", ["email", "card", "phone", "credential", "ip_address", "license"]).count().na.fill(0)


def _e(body: str) -> str:
    return f"with {ENTRIES_SQL} {body}"


_W20 = "over (partition by user_id order by us, event_id rows between 20 preceding and 1 preceding)"
_W6 = "over (partition by event_type order by us range between 21600000000 preceding and current row)"
QUERIES = {
    "history_filter": (history_filter, "select o_orderkey, o_orderpriority, o_totalprice from orders where o_orderdate >= '1996-01-01' and o_orderdate < '1997-01-01' and o_orderpriority in ('1-URGENT', '2-HIGH') order by o_totalprice desc, o_orderkey limit 50"),
    "retention": (retention, "select nth <= 3 as stays, count(*) as n, min(o_orderkey) as least, max(o_orderkey) as most from (select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as nth from orders) group by 1"),
    "sbom_components": (sbom_components, """select p_partkey, '{"type":"library","name":"' || p_name || '","version":"' || p_size || '","purl":"pkg:generic/' || replace(p_name, ' ', '-') || '@' || p_size || '"}' as component from part"""),
    "webhook_fanout": (webhook_fanout, "with h(hook, name) as (values ('audit', '*'), ('pager', 'error'), ('sales', 'purchase'), ('sales', 'signup'), ('none', 'refund')) select hook, count(*) as deliveries, max(event_id) as last_event from events join h on name = event_type or name = '*' group by hook"),
    "domain_activation": (domain_activation, "with w(event_type, domain, weight) as (values ('error', 'reliability', 0.3::double), ('error', 'security', 0.2::double), ('purchase', 'payments', 0.5::double), ('signup', 'identity', 0.4::double), ('view', 'content', 0.1::double), ('click', 'content', 0.2::double)), s as (select user_id, event_type, count(*) as n from events where value > 40 group by 1, 2), x as (select user_id, domain, round(sum(weight * least(n, 3)), 6) as score from s join w using (event_type) group by 1, 2) select user_id, domain, least(score, 1.0::double) as score from x where score >= 0.5"),
    "test_priorities": (test_priorities, "with l as (select l_partkey, count(distinct l_suppkey) as f, count(*) filter (l_returnflag = 'R') as r, count(*) as u from lineitem group by 1) select p_partkey, (2 * coalesce(f, 0) + 3 * coalesce(r, 0) + case when p_retailprice > 1000 then 5 else 0 end - least(coalesce(u, 0), 10))::bigint as score from part left join l on l_partkey = p_partkey order by score desc, p_partkey limit 20"),
    "benchmark_cases": (benchmark_cases, f"with {FINDINGS_SQL}, f as (select distinct doc_id from findings where type in ('email', 'card', 'credential', 'phone')) select *, round(hits / cases, 6) as rate from (select case when quality = 0 then 'vulnerable' else 'clean' end as kind, count(*) as cases, count(f.doc_id) as hits from labels l left join f on f.doc_id = l.doc_id group by 1)"),
    "cached_lookups": (cached_lookups, _e(", s as (select *, last_value(case when event_type = 'signup' then event_id end ignore nulls) over w as signup, last_value(case when event_type = 'signup' then us end ignore nulls) over w as signup_us from entries window w as (partition by user_id order by us, event_id rows between unbounded preceding and current row)) select event_id, case when us - signup_us <= 259200000000 then signup else -1 end as signup from s where event_type = 'error'")),
    "changed_domains": (changed_domains, "with p(pattern, domain, weight) as (values ('/en/', 'english', 0.6::double), ('/en', 'english', 0.3::double), ('spam', 'abuse', 0.9::double), ('cheap', 'abuse', 0.8::double), ('casino', 'abuse', 0.7::double), ('?', 'queries', 0.4::double), ('#', 'anchors', 0.2::double)), m as (select page_id, domain, max(weight) as weight from pages join p on contains(url, pattern) group by 1, 2 having max(weight) >= 0.4) select domain, count(*) as pages, max(weight) as weight from m group by domain"),
    "soak_windows": (soak_windows, _e(f"select event_id, event_type, n, slow from (select *, count(*) {_W6} as n, count(*) filter (value > 35) {_W6} as slow from entries) where n >= 10 and slow * 10 > n * 3")),
    "robust_outliers": (robust_outliers, _e(", m as (select event_type, quantile_cont(value, 0.5) as median from entries group by 1), o as (select event_id, event_type, abs(value - median) as off from entries join m using (event_type)), d as (select event_type, quantile_cont(off, 0.5) as mad from o group by 1) select event_id, round(off / mad, 6) as deviations from o join d using (event_type) where off > 6 * mad")),
    "change_risk": (change_risk, "with l as (select l_orderkey, count(*) as files, sum(l_quantity) as size, count(*) filter (l_discount > 0.05) as risky, bool_or(l_tax > 0.07) as migration from lineitem group by 1), s as (select least(least(files * 5, 25) + least(floor(size / 10), 25) + least(risky * 8, 30) + case when migration then 20 else 0 end, 100)::bigint as risk from l) select case when risk < 30 then 'low' when risk < 60 then 'medium' else 'high' end as level, count(*) as n, sum(risk)::bigint as total from s group by 1"),
    "bug_prediction": (bug_prediction, "select l_suppkey, round(0.4::double * count(distinct l_orderkey) + 0.1::double * count(distinct l_partkey) + 2 * count(*) filter (l_returnflag = 'R' and l_discount > 0.09), 4) as score from lineitem group by 1 having score > 15"),
    "token_costs": (token_costs, "select source, sum(n_chars * 13 // 10)::bigint as tokens, count(*) as n from documents group by 1"),
    "triage_spikes": (triage_spikes, _e(f"select event_id, n from (select event_id, value, count(*) {_W20} as n, avg(value) {_W20} as mean, stddev_pop(value) {_W20} as sd from entries) where n >= 5 and value > mean + 3.0001::double * sd")),
    "severity_pivot": (severity_pivot, f"with {FINDINGS_SQL} select string_split(file, '/')[1] as top, " + ", ".join(f"count(*) filter (type = '{t}') as {t}" for t in ("email", "card", "phone", "credential", "ip_address", "license")) + " from findings group by 1"),
}
