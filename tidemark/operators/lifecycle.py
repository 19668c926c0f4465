"""The life of findings between scans: merged shards, proximity groups, baselines, known false positives, gates.

Each operator is a function of DataFrames, columns and parameters; the registered queries below call it on
the supplied tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.functions import severity as sev
from tidemark.operators.findings import FINDINGS_SQL, GATE_SQL, findings, gate
from tidemark.operators.windows import ENTRIES_SQL, log
from tidemark.plans.shipping import ship
from tidemark.plans.tables import table

TOLERANCE = 5  # lines
WEEKLY_REDUCTION = 5
SECONDS_OF_DAY = 86_400


def merge_results(*parts: DataFrame) -> DataFrame:
    """Findings of all agents or shards in one table; a column that one part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def worst_first(rows: DataFrame, *ties: str, limit: int | None = None) -> DataFrame:
    """By severity rank, then ``ties``."""
    ordered = rows.orderBy(sev.rank(F.col("severity")), *(ties or ("file", "line")))
    return ordered if limit is None else ordered.limit(limit)


def by_score(rows: DataFrame, limit: int, score: str = "score", ties: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """The ``limit`` highest scores, ties in order."""
    return rows.orderBy(F.desc(score), *ties).limit(limit)


def counters(findings: DataFrame, key: str = "agent") -> DataFrame:
    """Findings and files of each agent, summed over all parts."""
    return findings.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))


def deltas(current: DataFrame, baseline: DataFrame, key: str = "agent") -> DataFrame:
    """Counts of each agent now and before; an agent without a baseline has its own count as one."""
    now, before = current.groupBy(key).agg(F.count(F.lit(1)).alias("current")), baseline.groupBy(key).agg(F.count(F.lit(1)).alias("before"))
    joined = now.join(before, key, "left").withColumn("baseline", F.coalesce("before", "current"))
    return joined.select(key, "current", "baseline", (F.col("current") - F.col("baseline")).alias("delta"))


def proximity_groups(rows: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """``rows`` (file, line, type, cwe) with the anchor of their group: anchor_line, anchor_type.

    In order of lines, a finding joins the last anchor of its own type and weakness within ``tolerance``
    lines, else the file's last anchor of its weakness (whatever type) within them, else it is an anchor
    itself. Findings without a weakness join their own type only. Rows pass by sorted, with the anchors of
    one file and weakness as all state, so no group is gathered.
    """
    ship(rows.sparkSession)
    schema = StructType([*rows.schema.fields, StructField("anchor_line", LongType()), StructField("anchor_type", StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, anchors, current = None, {}, None
        for batch in batches:
            found = []
            for file, cwe, line, kind in zip(*(batch.column(c).to_pylist() for c in ("file", "cwe", "line", "type")), strict=True):
                if (file, cwe) != group:
                    group, anchors, current = (file, cwe), {}, None
                if kind in anchors and line - anchors[kind] <= tolerance:
                    found.append((anchors[kind], kind))
                elif cwe and current and line - current[0] <= tolerance:
                    found.append(current)
                else:
                    anchors[kind], current = line, (line, kind)
                    found.append(current)
            columns = [pa.array([a for a, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema.names)

    ordered = rows.repartition("file", "cwe").sortWithinPartitions("file", "cwe", "line", "type")
    return ordered.mapInArrow(fold, schema)


def fingerprint() -> Column:
    """Sixteen hex digits over file, line, type, severity and message."""
    return F.substring(F.sha2(F.concat_ws(":", "file", F.col("line").cast("string"), "type", "severity", "message"), 256), 1, 16)


def baseline_states(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Every fingerprint of either scan: new, resolved or unchanged."""
    a = current.select(fingerprint().alias("fingerprint"), "type").distinct().withColumn("_new", F.lit(True))
    b = baseline.select(fingerprint().alias("fingerprint"), "type").distinct().withColumn("_old", F.lit(True))
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "resolved").otherwise("unchanged")
    return a.join(b, ["fingerprint", "type"], "full_outer").select("fingerprint", "type", state.alias("state"))


def known_flags(rows: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("file", "type", "line")) -> DataFrame:
    """``rows`` with known_fp: whether ``known`` has their file, type and line."""
    marked = known.select(*keys).distinct().withColumn("known_fp", F.lit(True))
    return rows.join(marked, list(keys), "left").withColumn("known_fp", F.coalesce("known_fp", F.lit(False)))


def upsert_snapshot(state: DataFrame, scan: DataFrame, key: str = "path") -> DataFrame:
    """State (key, hash, first_seen, last_seen) after a scan (key, hash, at): first_seen stays, what is gone stays."""
    new = scan.select(key, F.col("hash").alias("_hash"), "at")
    both = state.join(new, key, "full_outer")
    drift = F.when(F.col("hash").isNull(), "added").when(F.col("_hash").isNull(), "gone").when(F.col("hash") != F.col("_hash"), "changed").otherwise("unchanged")
    return both.select(key, F.coalesce("_hash", "hash").alias("hash"), F.coalesce("first_seen", "at").alias("first_seen"), F.coalesce("at", "last_seen").alias("last_seen"), drift.alias("drift"))


def stale(layers: DataFrame, sources: DataFrame, key: str = "path") -> DataFrame:
    """Layers whose source has another hash by now, or none."""
    now = sources.select(key, F.col("hash").alias("_now"))
    return layers.join(now, key, "left").where(~F.col("hash").eqNullSafe(F.col("_now"))).drop("_now")


# --- gates ----------------------------------------------------------------------------------------


def ratchet(count: Column, baseline: Column, weeks: Column, reduction: int = WEEKLY_REDUCTION) -> tuple[Column, Column]:
    """(target, passed) of a gate whose target falls by ``reduction`` each full week, to zero at least."""
    target = F.greatest(F.lit(0), baseline - weeks * reduction)
    return target, count <= target


def acceptance(rows: DataFrame, criteria: list[tuple[str, str, Column, str, float]]) -> DataFrame:
    """One row for each criterion (phase, name, aggregate, "most" or "least", bound) that ``rows`` violate."""
    values = rows.agg(*[value.cast("double").alias(f"v{i}") for i, (_, _, value, _, _) in enumerate(criteria)])
    tests = []
    for i, (phase, name, _, kind, bound) in enumerate(criteria):
        value = F.coalesce(F.col(f"v{i}"), F.lit(0.0))
        broken = value > bound if kind == "most" else value < bound
        tests.append(F.when(broken, F.struct(F.lit(phase).alias("phase"), F.lit(name).alias("criterion"), value.alias("value"), F.lit(float(bound)).alias("bound"))))
    return values.select(F.explode(F.array_compact(F.array(*tests))).alias("v")).select("v.*")


ROUTES = ("defend", "ai_analyze", "human_review", "discard")


def gate_calibration(cases: DataFrame) -> DataFrame:
    """For each tier of cases (kind, tier, actual): how many are real, and where they were routed."""
    vulnerable = F.avg((F.col("kind") == "vuln").cast("double"))
    return cases.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.round(vulnerable, 3).alias("vuln_fraction"), *[F.count_if(F.col("actual") == r).alias(r) for r in ROUTES])


def gate_score(cases: DataFrame) -> DataFrame:
    """One row over cases (kind, actual, expected): accuracy, recall and clean cases that were defended."""
    real = F.when(F.col("kind") == "vuln", (F.col("actual") != "discard").cast("double"))
    right = (F.col("actual") == F.col("expected")).cast("double")
    escapes = F.count_if((F.col("kind") == "clean") & (F.col("actual") == "defend"))
    g = cases.agg(F.count(F.lit(1)).alias("cases"), F.round(F.coalesce(F.avg(right), F.lit(1.0)), 3).alias("routing_accuracy"), F.round(F.coalesce(F.avg(real), F.lit(1.0)), 3).alias("vuln_recall"), escapes.alias("clean_escapes"), F.coalesce(F.bool_and(F.col("actual") == F.col("expected")), F.lit(True)).alias("_all"))
    return g.select("cases", "routing_accuracy", "vuln_recall", "clean_escapes", (F.col("_all") & (F.col("clean_escapes") == 0)).alias("ok"))


# --- jobs, runs and tests -------------------------------------------------------------------------


def next_jobs(jobs: DataFrame, queue: str = "queue") -> DataFrame:
    """The job that each queue takes next: highest priority, then oldest, then smallest id."""
    first = F.min_by(F.struct("id", "priority", "created"), F.struct((-F.col("priority")).alias("p"), "created", "id"))
    return jobs.groupBy(queue).agg(first.alias("j")).select(queue, "j.*")


def state_counts(jobs: DataFrame, keys: tuple[str, ...] = ("state",)) -> DataFrame:
    return jobs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def mutation_scores(mutants: DataFrame, key: str) -> DataFrame:
    """Share of a module's valid mutants (state: killed, survived, other) that tests killed."""
    killed, valid = F.count_if(F.col("state") == "killed"), F.count_if(F.col("state").isin("killed", "survived"))
    return mutants.groupBy(key).agg(killed.alias("killed"), valid.alias("valid"), F.count(F.lit(1)).alias("mutants")).withColumn("score", F.round(F.col("killed") / F.nullif(F.col("valid"), F.lit(0)), 4))


def with_results(runs: DataFrame, results: DataFrame, key: str = "run_id") -> DataFrame:
    """Test results with the run that they belong to."""
    return results.join(runs, key)


def blamed(rows: DataFrame, blame: DataFrame) -> DataFrame:
    """Findings with author and commit of their line; lines that nobody is blamed for keep nulls."""
    return rows.join(blame.select("file", "line", "author", "commit"), ["file", "line"], "left")


def scan_analytics(scans: DataFrame, rule_hits: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(totals by state with the mean number of findings, the ``top`` rules by hits)."""
    totals = scans.groupBy("state").agg(F.count(F.lit(1)).alias("scans"), F.round(F.avg("findings"), 1).alias("mean_findings"))
    rules = rule_hits.groupBy("rule").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "rule").limit(top)
    return totals, rules


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; null where the whole is nothing."""
    return part / F.nullif(whole, F.lit(0))


# --- registered queries ---------------------------------------------------------------------------


def _shards(spark, sf_dir):
    f = findings(spark, sf_dir)
    return [f.where(F.col("doc_id") % 3 == k) for k in range(3)]


def shard_counters(spark, sf_dir):
    return counters(merge_results(*_shards(spark, sf_dir)))


def shard_worst(spark, sf_dir):
    return worst_first(merge_results(*_shards(spark, sf_dir)), "file", "line", "type", limit=100).select("severity", "file", "line", "type")


def agent_deltas(spark, sf_dir):
    a, b, c = _shards(spark, sf_dir)
    return deltas(merge_results(a, b), b.where("agent <> 'legal'"))


def proximity(spark, sf_dir):
    f = findings(spark, sf_dir).select("file", "line", "type", "cwe")
    return proximity_groups(f).groupBy("file", "cwe", "anchor_line", "anchor_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("type").alias("types"))


PROXIMITY_SQL = "with recursive " + FINDINGS_SQL + """, o as (select file, cwe, type, line, row_number() over (partition by file, cwe order by line, type) as r from findings),
w as (select file, cwe, r, type, map {type: line} as anchors, line as cur_line, type as cur_type, line as a_line, type as a_type from o where r = 1
  union all select file, cwe, r, type, case when own or cross_ then anchors else map_concat(anchors, map {type: line}) end, case when own or cross_ then cur_line else line end,
    case when own or cross_ then cur_type else type end, case when own then mine when cross_ then cur_line else line end, case when own or not cross_ then type else cur_type end
  from (select o.file, o.cwe, o.r, o.type, o.line, w.anchors, w.cur_line, w.cur_type, list_extract(map_extract(w.anchors, o.type), 1) as mine,
          coalesce(o.line - list_extract(map_extract(w.anchors, o.type), 1) <= 5, false) as own, o.line - w.cur_line <= 5 as cross_ from w join o on o.file = w.file and o.cwe = w.cwe and o.r = w.r + 1))
select file, cwe, a_line as anchor_line, a_type as anchor_type, count(*) as n, count(distinct type) as types from w group by all"""


def baseline_fingerprints(spark, sf_dir):
    a, b, c = _shards(spark, sf_dir)
    return baseline_states(merge_results(a, b), merge_results(b, c)).groupBy("type", "state").agg(F.count(F.lit(1)).alias("n"))


def known_false_positives(spark, sf_dir):
    f = findings(spark, sf_dir)
    known = f.where("doc_id % 5 = 0 and line % 2 = 1").select("file", "type", "line")
    return known_flags(f, known).groupBy("type", "known_fp").agg(F.count(F.lit(1)).alias("n"))


def snapshot_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    state = d.where("path % 2 = 0").select("path", F.when(F.col("path") % 6 == 0, "old").otherwise(F.col("h")).alias("hash"), F.lit(1).alias("first_seen"), F.lit(1).alias("last_seen"))
    scan = d.where("path % 3 = 0").select("path", F.col("h").alias("hash"), F.lit(2).alias("at"))
    return upsert_snapshot(state, scan).groupBy("drift", "first_seen", "last_seen").agg(F.count(F.lit(1)).alias("n"))


def stale_layers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    layers = d.select("path", F.when(F.col("path") % 4 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    return stale(layers, d.where("path % 7 <> 0")).select("path")


def ratchet_gate(spark, sf_dir):
    """Errors a day against a target that starts with the first day's and falls weekly."""
    e = log(spark, sf_dir).where("status >= 500").groupBy(F.floor(F.col("us") / (SECONDS_OF_DAY * 1_000_000)).alias("day")).agg(F.count(F.lit(1)).alias("errors"))
    first = e.agg(F.min(F.struct("day", "errors")).alias("f")).select(F.col("f.day").alias("day0"), F.col("f.errors").alias("baseline"))
    j = e.join(F.broadcast(first))  # one row
    target, passed = ratchet(F.col("errors"), F.col("baseline"), F.floor((F.col("day") - F.col("day0")) / 7))
    return j.select("day", "errors", target.cast("long").alias("target"), passed.alias("passed"))


def acceptance_violations(spark, sf_dir):
    sure = F.col("severity")
    criteria = [
        ("scan", "critical findings", F.count_if(sure == "critical"), "most", 5), ("scan", "files", F.countDistinct("file"), "least", 1), ("plan", "low findings", F.count_if(sure == "low"), "least", 10**9),
        ("verify", "types", F.countDistinct("type"), "most", 3), ("verify", "share of info", F.avg((sure == "info").cast("double")), "most", 1.0),
    ]
    return acceptance(findings(spark, sf_dir), criteria)


def _cases(spark, sf_dir):
    kind = F.when(F.col("severity").isin("critical", "high"), "vuln").otherwise("clean")
    expected = F.when(F.col("severity") == "critical", "defend").when(F.col("severity") == "info", "discard").otherwise("ai_analyze")
    return gate(spark, sf_dir).select(kind.alias("kind"), "tier", F.col("routing").alias("actual"), expected.alias("expected"))


_CASES_SQL = "cases as (select case when severity in ('critical', 'high') then 'vuln' else 'clean' end as kind, tier, routing as actual, case severity when 'critical' then 'defend' when 'info' then 'discard' else 'ai_analyze' end as expected from g)"


def gate_tiers(spark, sf_dir):
    return gate_calibration(_cases(spark, sf_dir))


def gate_accuracy(spark, sf_dir):
    return gate_score(_cases(spark, sf_dir))


def job_queue(spark, sf_dir):
    jobs = log(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("event_type").alias("queue"), F.floor("value").alias("priority"), F.col("us").alias("created"))
    return next_jobs(jobs)


def job_states(spark, sf_dir):
    state = F.when(F.col("status") >= 500, "failed").when(F.col("value") > 50, "running").otherwise("done")
    return state_counts(log(spark, sf_dir).select("event_type", state.alias("state")), ("event_type", "state"))


def mutation_report(spark, sf_dir):
    state = F.when(F.col("l_returnflag") == "R", "killed").when(F.col("l_returnflag") == "A", "survived").otherwise("skipped")
    return mutation_scores(table(spark, sf_dir, "lineitem").select("l_suppkey", state.alias("state")), "l_suppkey")


def run_results(spark, sf_dir):
    """Lines as results of orders as runs: failures by the run's priority."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("branch"))
    results = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_returnflag") == "R").alias("failed"))
    return with_results(runs, results).groupBy("branch").agg(F.count(F.lit(1)).alias("results"), F.count_if("failed").alias("failures"))


def blame_report(spark, sf_dir):
    f = findings(spark, sf_dir)
    blame = f.where("line % 3 <> 0").select("file", "line", F.concat(F.lit("dev"), (F.col("line") % 4).cast("string")).alias("author"), F.lit("c0").alias("commit")).distinct()
    return blamed(f, blame).groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))


def scan_totals(spark, sf_dir):
    per = findings(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("findings"))
    scans = table(spark, sf_dir, "documents").join(per, "doc_id", "left").select(F.when(F.col("doc_id") % 5 == 0, "failed").otherwise("done").alias("state"), F.coalesce("findings", F.lit(0)).alias("findings"))
    return scan_analytics(scans, findings(spark, sf_dir).select(F.col("type").alias("rule")))[0]


def top_rules(spark, sf_dir):
    f = findings(spark, sf_dir).select(F.col("type").alias("rule"))
    return scan_analytics(f.select(F.lit("done").alias("state"), F.lit(0).alias("findings")), f)[1]


def dead_code_ratio(spark, sf_dir):
    """Parts that no line uses, by brand: an unused share that is null where there is nothing."""
    used = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("used", F.lit(1))
    g = table(spark, sf_dir, "part").join(used, "p_partkey", "left").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count("used").alias("used"))
    return g.select("p_brand", "n", F.round(ratio((F.col("n") - F.col("used")).cast("double"), F.col("n").cast("double")), 6).alias("unused"))


def _q(body: str) -> str:
    return "with " + FINDINGS_SQL + " " + body


_FP = "substr(sha256(concat_ws(':', file, line::varchar, type, severity, message)), 1, 16)"
_STATE_SQL = "d as (select doc_id as path, md5(coalesce(text, '')) as h from documents)"
QUERIES = {
    "shard_counters": (shard_counters, _q("select agent, count(*) as n, count(distinct file) as files from findings group by agent")),
    "shard_worst": (shard_worst, _q(f"select severity, file, line, type from findings order by {sev.RANK_SQL.format('severity')}, file, line, type limit 100")),
    "agent_deltas": (agent_deltas, _q(", c as (select agent, count(*) as current from findings where doc_id % 3 in (0, 1) group by 1), b as (select agent, count(*) as n from findings where doc_id % 3 = 1 and agent <> 'legal' group by 1) select agent, current, coalesce(n, current) as baseline, current - coalesce(n, current) as delta from c left join b using (agent)")),
    "proximity_groups": (proximity, PROXIMITY_SQL),
    "baseline_fingerprints": (baseline_fingerprints, _q(f", a as (select distinct {_FP} as fp, type from findings where doc_id % 3 in (0, 1)), b as (select distinct {_FP} as fp, type from findings where doc_id % 3 in (1, 2)) select type, 'new' as state, count(*) as n from (select * from a except select * from b) group by type union all select type, 'resolved', count(*) from (select * from b except select * from a) group by type union all select type, 'unchanged', count(*) from (select * from a intersect select * from b) group by type")),
    "known_false_positives": (known_false_positives, _q(", k as (select distinct file, type, line from findings where doc_id % 5 = 0 and line % 2 = 1) select type, (file, type, line) in (select (file, type, line) from k) as known_fp, count(*) as n from findings group by all")),
    "snapshot_upsert": (snapshot_upsert, f"with {_STATE_SQL}, s as (select path, case when path % 6 = 0 then 'old' else h end as h from d where path % 2 = 0), n as (select path, h from d where path % 3 = 0) select case when s.path is null then 'added' when n.path is null then 'gone' when s.h <> n.h then 'changed' else 'unchanged' end as drift, case when s.path is null then 2 else 1 end as first_seen, case when n.path is null then 1 else 2 end as last_seen, count(*) as n from s full join n on s.path = n.path group by all"),
    "stale_layers": (stale_layers, "select doc_id as path from documents where doc_id % 4 = 0 or doc_id % 7 = 0"),
    "ratchet_gate": (ratchet_gate, f"with {ENTRIES_SQL}, e as (select us // 86400000000 as day, count(*) as errors from entries where status >= 500 group by 1), f as (select min(day) as day0, arg_min(errors, day) as baseline from e) select day, errors, greatest(0, baseline - 5 * ((day - day0) // 7))::bigint as target, errors <= greatest(0, baseline - 5 * ((day - day0) // 7)) as passed from e, f"),
    "acceptance_violations": (acceptance_violations, _q(", v as (select count(*) filter (severity = 'critical') as a, count(distinct file) as b, count(*) filter (severity = 'low') as c, count(distinct type) as d from findings) select 'scan' as phase, 'critical findings' as criterion, a::double as value, 5.0::double as bound from v where a > 5 union all select 'scan', 'files', b, 1 from v where b < 1 union all select 'plan', 'low findings', c, 1e9 from v where c < 1000000000 union all select 'verify', 'types', d, 3 from v where d > 3")),
    "gate_tiers": (gate_tiers, f"with g as (with {GATE_SQL}), {_CASES_SQL} select tier, count(*) as n, round(avg((kind = 'vuln')::int::double), 3) as vuln_fraction, " + ", ".join(f"count(*) filter (actual = '{r}') as {r}" for r in ROUTES) + " from cases group by tier"),
    "gate_accuracy": (gate_accuracy, f"with g as (with {GATE_SQL}), {_CASES_SQL}, s as (select count(*) as cases, round(avg((actual = expected)::int::double), 3) as routing_accuracy, round(avg((actual <> 'discard')::int::double) filter (kind = 'vuln'), 3) as vuln_recall, count(*) filter (kind = 'clean' and actual = 'defend') as clean_escapes, bool_and(actual = expected) as a from cases) select cases, routing_accuracy, vuln_recall, clean_escapes, a and clean_escapes = 0 as ok from s"),
    "job_queue": (job_queue, f"with {ENTRIES_SQL} select event_type as queue, event_id as id, floor(value)::bigint as priority, us as created from entries qualify row_number() over (partition by event_type order by floor(value) desc, us, event_id) = 1"),
    "job_states": (job_states, f"with {ENTRIES_SQL} select event_type, case when status >= 500 then 'failed' when value > 50 then 'running' else 'done' end as state, count(*) as n from entries group by all"),
    "mutation_report": (mutation_report, "with g as (select l_suppkey, count(*) filter (l_returnflag = 'R') as killed, count(*) filter (l_returnflag in ('R', 'A')) as valid, count(*) as mutants from lineitem group by 1) select *, round(killed / nullif(valid, 0), 4) as score from g"),
    "run_results": (run_results, "select o_orderpriority as branch, count(*) as results, count(*) filter (l_returnflag = 'R') as failures from lineitem join orders on o_orderkey = l_orderkey group by 1"),
    "blame_report": (blame_report, _q("select case when line % 3 <> 0 then 'dev' || line % 4 end as author, count(*) as n, count(distinct file) as files from findings group by 1")),
    "scan_totals": (scan_totals, _q(", p as (select doc_id, count(*) as n from findings group by 1) select case when doc_id % 5 = 0 then 'failed' else 'done' end as state, count(*) as scans, round(avg(coalesce(n, 0)), 1) as mean_findings from documents left join p using (doc_id) group by 1")),
    "top_rules": (top_rules, _q("select type as rule, count(*) as hits from findings group by 1 order by 2 desc, 1 limit 10")),
    "dead_code_ratio": (dead_code_ratio, "select p_brand, count(*) as n, round(count(*) filter (p_partkey not in (select l_partkey from lineitem)) / count(*)::double, 6) as unused from part group by 1"),
}
