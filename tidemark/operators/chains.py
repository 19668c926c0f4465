"""Exploit chains over findings: roles, links by rule and place, paths, trees by goal, and scenario scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import severity as sev
from tidemark.plans.staging import stage
from tidemark.plans.tables import table

# Fixed values. Words of a finding's type, in the order in which roles are tried.
ENTRY = ("auth", "cors", "debug", "rate_limit", "redirect", "open")
EXPLOIT = ("inject", "xss", "ssrf", "idor", "deserial", "traversal", "rce", "sqli", "xxe")
IMPACT = ("secret", "crypto", "sensitive", "session", "jwt", "hardcoded", "password", "key")
#: Words of two types of which the first leads to the second.
LEADS_TO = [
    ("auth", "inject"), ("auth", "xss"), ("auth", "ssrf"), ("auth", "idor"), ("open_redirect", "xss"), ("cors", "xss"), ("debug", "inject"), ("rate_limit", "brute"), ("rate_limit", "inject"),
    ("inject", "secret"), ("inject", "sensitive_data"), ("ssrf", "secret"), ("idor", "sensitive_data"), ("xss", "session"), ("xss", "secret"), ("deserialization", "rce"), ("command_injection", "secret"),
    ("path_traversal", "secret"), ("weak_crypto", "session"), ("hardcoded_secret", "secret"), ("jwt", "auth"), ("csrf", "state_change"),
]
CHAIN_WEIGHTS = {"info": 5, "low": 15, "medium": 35, "high": 70, "critical": 90}
GOALS = [
    ("secret", "Steal Credentials / Secrets"), ("hardcoded", "Steal Credentials / Secrets"), ("password", "Steal Credentials / Secrets"), ("sensitive_data", "Exfiltrate Sensitive Data"),
    ("session", "Impersonate Users"), ("rce", "Execute Arbitrary Code"), ("deserialization", "Execute Arbitrary Code"), ("command_injection", "Execute Arbitrary Code"),
]
CATEGORIES = {
    "authentication": ("auth", "login", "session", "password", "jwt", "cookie"), "authorization": ("permission", "role", "admin", "access", "privilege"), "injection": ("sql", "injection", "command", "eval", "exec", "shell", "xss"),
    "secrets": ("secret", "credential", "api_key", "token", "hardcoded"), "crypto": ("hash", "md5", "sha1", "encrypt", "decrypt", "cipher"), "configuration": ("config", "debug", "cors", "ssl", "tls", "verbose"),
    "network": ("ssrf", "redirect", "request", "fetch", "url"), "dependencies": ("dependency", "vulnerability", "outdated", "cve"),
}
ROLES = ("entry", "exploit", "impact")


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def role(kind: Column) -> Column:
    """entry, exploit, impact or standalone."""
    k = F.lower(kind)
    return F.when(_has(k, ENTRY), "entry").when(_has(k, EXPLOIT), "exploit").when(_has(k, IMPACT), "impact").otherwise("standalone")


def category(kind: Column) -> Column:
    """Threat category by the first list of words that has one of the type's; else ``other``."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    return reduce(lambda acc, c: F.when(_has(k, c[1]), c[0]).otherwise(acc), reversed(CATEGORIES.items()), F.lit("other"))


def goal(kind: Column) -> Column:
    k = F.lower(kind)
    return reduce(lambda acc, g: F.when(k.contains(g[0]), g[1]).otherwise(acc), reversed(GOALS), F.lit(None).cast("string"))


def chain_links(nodes: DataFrame, edges: DataFrame | None = None, rules: list[tuple[str, str]] = LEADS_TO) -> DataFrame:
    """(u, v, rule): finding ``u`` leads to ``v`` by the first rule that fits, in one file or along an import.

    ``nodes``: id, file, type; ``edges``: src, dst files. Rules become keys of an equi-join: a node offers the
    rules whose first word its type has, and takes those whose second word it has. Roles never go back.
    """
    order = F.array_position(F.array(*map(F.lit, ROLES)), role(F.col("type")))
    n = nodes.select("id", "file", "type", order.alias("step")).where("step > 0")
    tags = lambda side: F.explode(F.array_compact(F.array(*[F.when(F.lower("type").contains(r[side]), F.lit(i)) for i, r in enumerate(rules)])))
    gives = n.select(F.col("id").alias("u"), "file", F.col("step").alias("su"), tags(0).alias("rule"))
    takes = n.select(F.col("id").alias("v"), F.col("file").alias("to"), F.col("step").alias("sv"), tags(1).alias("rule"))
    reach = gives.withColumn("to", F.col("file"))
    if edges is not None:
        reach = reach.unionByName(gives.join(edges.select(F.col("src").alias("file"), F.col("dst").alias("to")).where("file <> to").distinct(), "file"))
    met = reach.join(takes, ["rule", "to"]).where("u <> v and su <= sv")
    return met.groupBy("u", "v").agg(F.min("rule").alias("rule"))


def exploit_chains(nodes: DataFrame, links: DataFrame, depth: int = 5) -> DataFrame:
    """Paths entry -> ... -> exploit or impact of at most ``depth`` nodes, and exploit -> impact pairs, each once.

    path, length, severity (at least high from two nodes on, critical from three), score 0 to 100, first_type,
    last_type. One written table a round; an impact ends its path.
    """
    n = nodes.select("id", "type", "agent", role(F.col("type")).alias("role"), sev.rank(F.col("severity")).alias("rank"), sev.lookup(F.col("severity"), CHAIN_WEIGHTS, 20).alias("weight"))
    ends = links.join(n.select(F.col("id").alias("v"), F.col("type").alias("t"), F.col("agent").alias("a"), F.col("role").alias("r"), F.col("rank").alias("k"), F.col("weight").alias("w")), "v")
    ends = stage(ends.select("u", "v", "t", "a", "r", "k", "w"), "chain-steps")
    start = n.where("role in ('entry', 'exploit')").select(F.array("id").alias("path"), F.col("id").alias("at"), F.col("role").alias("from"), F.col("type").alias("first_type"), F.col("type").alias("last_type"), "role", F.array("agent").alias("agents"), "rank", "weight")
    front, found = start, None
    for _ in range(depth - 1):
        step = front.where("role <> 'impact'").join(ends, F.col("at") == F.col("u")).where(~F.array_contains("path", F.col("v")) & ((F.col("from") == "entry") | (F.col("r") == "impact")))
        front = stage(step.select(F.concat("path", F.array("v")).alias("path"), F.col("v").alias("at"), "from", "first_type", F.col("t").alias("last_type"), F.col("r").alias("role"), F.array_union("agents", F.array("a")).alias("agents"), F.least("rank", "k").alias("rank"), F.greatest("weight", "w").alias("weight")), "chain-front")
        ended = front.where("role in ('exploit', 'impact')")
        found = ended if found is None else found.unionByName(ended)
        if front.isEmpty():
            break
        front = front.where(F.col("from") == "entry")
    length = F.size("path").cast("long")
    worst = F.least("rank", F.when(length >= 3, 0).otherwise(1))
    score = F.least(F.col("weight") + F.least((length - 1) * 8, F.lit(24)) + F.least(F.size("agents") * 4, F.lit(12)), F.lit(100))
    return found.select("path", length.alias("length"), F.element_at(F.array(*map(F.lit, sev.NAMES)), (worst + 1).cast("int")).alias("severity"), score.cast("long").alias("score"), "first_type", "last_type").dropDuplicates(["path"])


def worst_chains(chains: DataFrame, most: int = 50) -> DataFrame:
    """The report: the ``most`` chains of the highest score, ties by their steps."""
    return chains.orderBy(F.desc("score"), "path").limit(most)


def attack_trees(chains: DataFrame, branches: int = 6) -> DataFrame:
    """Chains by what their last step gives an attacker: how many, the worst severity, the best ``branches``."""
    g = chains.withColumn("goal", goal(F.col("last_type"))).where("goal is not null").withColumn("_rank", sev.rank(F.col("severity")))
    shown = F.concat_ws(" > ", "first_type", "last_type")
    best = g.select("goal", "score", shown.alias("branch")).groupBy("goal", "branch").agg(F.max("score").alias("score"))
    tops = best.groupBy("goal").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "branch"))), 1, branches).alias("b"))  # a branch is a pair of types
    trees = g.groupBy("goal").agg(F.count(F.lit(1)).alias("chains"), F.min("_rank").alias("_rank")).join(tops, "goal")
    worst = F.element_at(F.array(*map(F.lit, sev.NAMES)), F.col("_rank") + 1)
    return trees.select("goal", "chains", worst.alias("worst_severity"), F.array_join(F.transform("b", lambda x: x["branch"]), "; ").alias("branches"))


def chain_membership(chains: DataFrame) -> DataFrame:
    """For each finding the chains of a (capped) report that it is a step of."""
    steps = chains.select(F.array_join("path", ">").alias("chain"), F.explode("path").alias("id"))
    return steps.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("chain")), ",").alias("chains"), F.count(F.lit(1)).alias("n"))


def scenario_relevance(scenarios: DataFrame, signals: DataFrame, weights: DataFrame, unknown: float = 0.2) -> DataFrame:
    """Scenarios (id, category) with the weighted share of their category's signals that a project shows, 0 to 1."""
    w = weights.join(signals, "signal", "left").groupBy("category").agg((F.sum(F.coalesce("strength", F.lit(0.0)) * F.col("weight")) / F.sum("weight")).alias("share"))
    return scenarios.join(F.broadcast(w), "category", "left").withColumn("relevance", F.round(F.coalesce(F.least("share", F.lit(1.0)), F.lit(unknown)), 6)).drop("share")  # a row a category


def rescored(scenarios: DataFrame, rows: DataFrame, boost: float = 0.15, decay: float = 0.05, cwe_boost: float = 0.2) -> DataFrame:
    """Scenarios (id, category, cwe, relevance) after a scan: boosted by findings of their category, else decayed."""
    by_category = rows.groupBy(category(F.col("type")).alias("category")).agg(F.count(F.lit(1)).alias("_n"))
    by_cwe = rows.where("cwe <> ''").select("cwe").distinct().withColumn("_cwe", F.lit(True))
    j = scenarios.join(by_category, "category", "left").join(by_cwe, "cwe", "left")
    moved = F.when(F.col("_n") > 0, F.least(F.col("relevance") + F.col("_n") * boost, F.lit(1.0))).otherwise(F.greatest(F.col("relevance") - decay, F.lit(0.0)))
    return j.select("id", "category", "cwe", F.round(F.when(F.col("_cwe"), F.least(moved + cwe_boost, F.lit(1.0))).otherwise(moved), 6).alias("relevance"))


# --- registered queries ---------------------------------------------------------------------------

KINDS = ["auth_bypass", "sql_injection", "hardcoded_secret", "reflected_xss", "session_fixation", "open_redirect", "style"]


def _nodes(spark, sf_dir):
    """Errors as findings; a user is a file."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("event_id") % 7 + 1).cast("int"))
    severity = F.when(F.col("value") > 60, "high").when(F.col("value") > 20, "medium").otherwise("low")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), kind.alias("type"), severity.alias("severity"), F.concat(F.lit("a"), (F.col("event_id") % 3).cast("string")).alias("agent"), F.lit("").alias("cwe"))


def _any(col: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({col}, '{w}')" for w in words) + ")"


_NODES_SQL = f"""n0 as (select event_id as id, 'f' || user_id as file, {KINDS}[event_id % 7 + 1] as type, case when value > 60 then 'high' when value > 20 then 'medium' else 'low' end as severity, 'a' || event_id % 3 as agent from events where event_type = 'error'),
n as (select *, case when {_any('type', ENTRY)} then 1 when {_any('type', EXPLOIT)} then 2 when {_any('type', IMPACT)} then 3 else 0 end as step from n0),
r(i, s, d) as (values {', '.join(f"({i}, '{s}', '{d}')" for i, (s, d) in enumerate(LEADS_TO))}),
l as (select a.id as u, b.id as v, min(i) as rule from n a join n b on a.file = b.file and a.id <> b.id and a.step > 0 and a.step <= b.step join r on contains(a.type, s) and contains(b.type, d) group by a.id, b.id)"""
_CHAINS_SQL = f"""{_NODES_SQL}, w as (select [id] as path, id as pos, step as origin, type as first_type, type as last_type, step, [agent] as agents, case severity when 'high' then 70 when 'medium' then 35 else 15 end as weight from n where step in (1, 2)
  union all select list_append(path, l.v), l.v, origin, first_type, n.type, n.step, list_append(agents, n.agent), greatest(weight, case n.severity when 'high' then 70 when 'medium' then 35 else 15 end)
  from w join l on w.pos = l.u join n on n.id = l.v where w.step < 3 and len(path) < 5 and not list_contains(path, l.v) and (origin = 1 or n.step = 3 and len(path) = 1)),
c as (select distinct path, len(path) as length, case when len(path) >= 3 then 'critical' else 'high' end as severity, least(weight + least((len(path) - 1) * 8, 24) + least(len(list_distinct(agents)) * 4, 12), 100)::bigint as score, first_type, last_type from w where len(path) > 1 and step in (2, 3))"""


def finding_links(spark, sf_dir):
    return chain_links(_nodes(spark, sf_dir)).select("u", "v", F.col("rule").cast("long").alias("rule"))


def _chains(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return exploit_chains(n, chain_links(n))


def exploit_report(spark, sf_dir):
    return worst_chains(_chains(spark, sf_dir)).select(F.array_join("path", ">").alias("chain"), "length", "severity", "score")


def attack_goals(spark, sf_dir):
    return attack_trees(_chains(spark, sf_dir))


def chain_members(spark, sf_dir):
    return chain_membership(worst_chains(_chains(spark, sf_dir)))


def role_counts(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return n.groupBy(role(F.col("type")).alias("role"), category(F.col("type")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


SCENARIOS = [("S1", "injection", "CWE-89", 0.3), ("S2", "secrets", "CWE-798", 0.9), ("S3", "crypto", "CWE-327", 0.02), ("S4", "authentication", "", 0.5)]
SIGNALS = [("injection", "click", 2.0), ("injection", "view", 1.0), ("secrets", "signup", 1.0), ("secrets", "refund", 3.0)]


def scenario_scores(spark, sf_dir):
    """Scenarios after a scan of errors; the weakness of a finding is that of its document type."""
    n = _nodes(spark, sf_dir).withColumn("cwe", F.when(F.col("type") == "hardcoded_secret", "CWE-798").otherwise(""))
    return rescored(spark.createDataFrame(SCENARIOS, "id string, category string, cwe string, relevance double"), n)


def scenario_signals(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("signal")).agg(F.count(F.lit(1)).alias("n"))
    strength = e.join(F.broadcast(e.agg(F.max("n").alias("most")))).select("signal", (F.col("n") / F.col("most")).alias("strength"))  # one row
    scenarios = spark.createDataFrame(SCENARIOS, "id string, category string, cwe string, relevance double").select("id", "category")
    return scenario_relevance(scenarios, strength, spark.createDataFrame(SIGNALS, "category string, signal string, weight double"))


def _category_sql(col: str) -> str:
    return "case " + " ".join(f"when {_any(col, words)} then '{name}'" for name, words in CATEGORIES.items()) + " else 'other' end"


_GOAL_SQL = "case " + " ".join(f"when contains(last_type, '{w}') then '{g}'" for w, g in GOALS) + " end"
_SCENARIO_SQL = "s(id, category, cwe, relevance) as (values " + ", ".join(f"('{i}', '{c}', '{w}', {r}::double)" for i, c, w, r in SCENARIOS) + ")"
QUERIES = {
    "finding_links": (finding_links, f"with {_NODES_SQL} select u, v, rule::bigint as rule from l"),
    "exploit_chains": (exploit_report, f"with recursive {_CHAINS_SQL} select array_to_string(path, '>') as chain, length, severity, score from c order by score desc, path limit 50"),
    "attack_trees": (attack_goals, f"with recursive {_CHAINS_SQL}, g as (select *, {_GOAL_SQL} as goal from c), b as (select goal, first_type || ' > ' || last_type as branch, max(score) as score from g where goal is not null group by 1, 2), t as (select goal, list(branch order by score desc, branch)[1:6] as top from b group by 1) select goal, count(*) as chains, case when bool_or(severity = 'critical') then 'critical' else 'high' end as worst_severity, array_to_string(any_value(top), '; ') as branches from g join t using (goal) group by goal"),
    "chain_members": (chain_members, f"with recursive {_CHAINS_SQL}, x as (select path from c order by score desc, path limit 50), e as (select array_to_string(path, '>') as chain, unnest(path) as id from x) select id, array_to_string(list_sort(list(chain)), ',') as chains, count(*) as n from e group by id"),
    "finding_roles": (role_counts, f"with {_NODES_SQL} select ['standalone', 'entry', 'exploit', 'impact'][step + 1] as role, {_category_sql('type')} as category, count(*) as n from n group by 1, 2"),
    "scenario_scores": (scenario_scores, f"with {_NODES_SQL}, {_SCENARIO_SQL}, k as (select {_category_sql('type')} as category, count(*) as n from n group by 1), m as (select s.*, case when k.n > 0 then least(relevance + n * 0.15::double, 1.0::double) else greatest(relevance - 0.05::double, 0.0::double) end as moved from s left join k using (category)) select id, category, cwe, round(case when cwe = 'CWE-798' and exists (select 1 from n where type = 'hardcoded_secret') then least(moved + 0.2::double, 1.0::double) else moved end, 6) as relevance from m"),
    "scenario_relevance": (scenario_signals, f"with {_SCENARIO_SQL}, w(category, signal, weight) as (values " + ", ".join(f"('{c}', '{s}', {v}::double)" for c, s, v in SIGNALS) + "), e as (select event_type as signal, count(*) as n from events group by 1), t as (select category, sum(coalesce(n / (select max(n) from e), 0) * weight) / sum(weight) as share from w left join e using (signal) group by 1) select id, category, round(coalesce(least(share, 1.0::double), 0.2::double), 6) as relevance from s left join t using (category)"),
}
