"""Detectors over text lines, and what is done with their findings: noise, merging, scoring, routing.

Rules are data: a detector is a row of pattern, type, severity and weakness id, and all rules run in one
pass over the lines. Everything is a column expression, so a scan never leaves code generation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import severity as sev
from tidemark.functions.paths import noise
from tidemark.functions.text import classes, entropy, keep_four, license_status, luhn
from tidemark.plans.folds import fold_groups
from tidemark.plans.tables import table

#: agent, type, severity, weakness, pattern; first match of a line counts. Fixed values.
RULES = [
    ("pii", "email", "medium", "CWE-359", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("pii", "card", "high", "CWE-359", r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"),
    ("pii", "ssn", "high", "CWE-359", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    ("pii", "phone", "low", "CWE-359", r"\(?[0-9]{3}\)?[-. ]?[0-9]{3}[-. ]?[0-9]{4}"),
    ("infra", "ip_address", "medium", "CWE-200", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    ("secrets", "credential", "critical", "CWE-798", r"(?i)(?:password|passwd|secret|token|api_?key) *[:=] *[^ ]+"),
    ("legal", "license", "info", "CWE-1104", r"(?i)licen[sc]e|copyright"),
]
OWASP = {"CWE-359": "A01 Broken Access Control", "CWE-798": "A07 Authentication Failures", "CWE-200": "A01 Broken Access Control"}


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, file, line (from 1) and body of every line."""
    file = F.concat("source", F.lit("/"), F.when(F.col("doc_id") % 10 == 0, "tests/test_").when(F.col("doc_id") % 10 == 1, "docs/").otherwise("src/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 10 == 1, ".md").otherwise(".py"))
    exploded = docs.select("doc_id", file.alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("at", "body"))
    return exploded.select("doc_id", "file", (F.col("at") + 1).cast("long").alias("line"), "body")


LINES_SQL = """lines as (
  select doc_id, source || '/' || case when doc_id % 10 = 0 then 'tests/test_' when doc_id % 10 = 1 then 'docs/' else 'src/' end || doc_id || case when doc_id % 10 = 1 then '.md' else '.py' end as file,
         unnest(range(1, len(l) + 1)) as line, unnest(l) as body from (select *, string_split(text, chr(10)) as l from documents))"""


def scan(rows: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """Findings of all rules in one pass: one row for each rule that a line matches."""
    hits = [
        F.struct(F.lit(a).alias("agent"), F.lit(t).alias("type"), F.lit(s).alias("severity"), F.lit(c).alias("cwe"), F.regexp_extract("body", p, 0).alias("message"))
        for a, t, s, c, p in rules
    ]
    found = rows.withColumn("hit", F.explode(F.filter(F.array(*hits), lambda h: h["message"] != ""))).select("doc_id", "file", "line", "hit.*")
    return found.where((F.col("type") != "card") | luhn(F.regexp_replace("message", "[ -]", "")))


def _scan_sql() -> str:
    parts = [f"select doc_id, file, line, '{a}' as agent, '{t}' as type, '{s}' as severity, '{c}' as cwe, regexp_extract(body, '{p}', 0) as message from lines" for a, t, s, c, p in RULES]
    return LINES_SQL + ", raw as (" + " union all ".join(parts) + """), cards as (
  select doc_id, line, message, list_sum(list_transform(range(1, 17), lambda i: case when i % 2 = 0 then d[17 - i] * 2 % 10 + d[17 - i] // 5 else d[17 - i] end)) % 10 = 0 as ok
  from (select distinct doc_id, line, message, list_transform(string_split(regexp_replace(message, '[ -]', '', 'g'), ''), lambda c: c::int) as d from raw where type = 'card' and message <> '')
), findings as (select * from raw where message <> '' and (type <> 'card' or (doc_id, line, message) in (select (doc_id, line, message) from cards where ok)))"""


FINDINGS_SQL = _scan_sql()


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(lines(table(spark, sf_dir, "documents")))


def scan_findings(spark, sf_dir):
    return findings(spark, sf_dir)


def severity_counts(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files")).withColumn("rank", sev.rank(F.col("severity")))


def counts_by_agent_and_type(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("agent", "type", "severity").agg(F.count(F.lit(1)).alias("n"))


def worst_first_page(spark, sf_dir):
    """Second page of 50, worst first, with the total before paging."""
    f = findings(spark, sf_dir).select("severity", "file", "line", "type")
    total = f.agg(F.count(F.lit(1)).alias("total"))
    page = f.orderBy(sev.rank(F.col("severity")), "file", "line", "type").offset(50).limit(50)
    return page.join(F.broadcast(total))  # one row


def noise_report(spark, sf_dir):
    f = findings(spark, sf_dir).withColumn("category", F.coalesce(noise(F.col("file")), F.lit("source")))
    return f.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("severity") != "info") & (F.col("category") != "source")).alias("capped"))


def noise_capped(spark, sf_dir):
    """Findings outside source are kept as info and carry their category."""
    category = noise(F.col("file"))
    return findings(spark, sf_dir).select("file", "line", "type", F.when(category.isNotNull(), "info").otherwise(F.col("severity")).alias("severity"), category.alias("noise_category"))


NOISE_SQL = "case when regexp_matches(file, '/docs/') then 'docs' when regexp_matches(file, '/tests/') then 'tests' end"


def merged(spark, sf_dir):
    """One row a file and weakness: confirmations, worst severity, composite score."""
    f = findings(spark, sf_dir).withColumn("rank", sev.rank(F.col("severity")))
    g = f.groupBy("file", "cwe").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("confirmed_by"), F.min("rank").alias("rank"), F.countDistinct("type").alias("confirmations"), F.min("line").alias("line"), F.count(F.lit(1)).alias("n"))
    worst = F.element_at(F.array(*map(F.lit, sev.NAMES)), F.col("rank") + 1)
    return g.select("file", "cwe", "confirmed_by", "confirmations", "line", "n", worst.alias("severity"), sev.composite(worst, F.col("confirmations")).alias("score"))


MERGED_SQL = FINDINGS_SQL + f""", merged as (
  select file, cwe, array_to_string(list_sort(list_distinct(list(type))), ',') as confirmed_by, count(distinct type) as confirmations, min(line) as line, count(*) as n,
         ['critical', 'high', 'medium', 'low', 'info'][min({sev.RANK_SQL.format('severity')}) + 1] as severity from findings group by file, cwe)"""
SCORE_SQL = f"least(100.0::double, {sev.sql_case('severity', sev.WEIGHTS, 0.0)}::double * 10 + least(confirmations * 3.0::double, 15.0::double))"


def owasp_rollup(spark, sf_dir):
    """Weakness to category by a small dimension, with a default for what it lacks."""
    dim = spark.createDataFrame(list(OWASP.items()), "cwe string, category string")
    f = findings(spark, sf_dir).join(F.broadcast(dim), "cwe", "left")  # the dimension is a constant
    return f.groupBy(F.coalesce("category", F.lit("A05 Security Misconfiguration")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def gate(spark, sf_dir):
    """Confidence, tier and routing of merged findings; every 13th file is a known false positive."""
    m = merged(spark, sf_dir).withColumn("noise", noise(F.col("file")).isNotNull())
    known = table(spark, sf_dir, "documents").where("doc_id % 13 = 0").select(F.concat("source", F.lit("/src/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file"), F.lit(True).alias("known_fp")).distinct()
    m = m.join(known, "file", "left")
    method = F.when(F.col("score") >= 70, 0.9).when(F.col("cwe") != "", 0.5).otherwise(0.3)
    raw = method + sev.lookup(F.col("severity"), sev.GATE_BONUS, 0.0) + F.least(F.col("confirmations") * 0.1, F.lit(0.3)) + F.when(F.col("line") > 0, 0.1).otherwise(0.0)
    raw = raw - F.when(F.coalesce("known_fp", F.lit(False)), 0.4).otherwise(0.0) - F.when(F.col("noise"), 0.3).otherwise(0.0) - 0.2
    confidence = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)
    tier = F.when(F.col("confidence") >= 0.7, "high").when(F.col("confidence") >= 0.4, "medium").otherwise("low")
    routing = (
        F.when((F.col("tier") == "high") & (F.col("noise") | (F.col("confirmations") < 2)), "ai_analyze")
        .when(F.col("tier") == "high", "defend")
        .when(F.col("tier") == "medium", "ai_analyze")
        .when(F.col("severity").isin("critical", "high"), "human_review")
        .otherwise("discard")
    )
    return m.withColumn("confidence", confidence).withColumn("tier", tier).select("file", "cwe", "severity", "confidence", "tier", routing.alias("routing"))


GATE_SQL = MERGED_SQL + f""", known as (select distinct source || '/src/' || doc_id || '.py' as file from documents where doc_id % 13 = 0),
g as (select m.*, {NOISE_SQL.replace('file', 'm.file')} is not null as noise, k.file is not null as known_fp, {SCORE_SQL} as score from merged m left join known k on m.file = k.file),
c as (select *, round(greatest(0.0::double, least(1.0::double, case when score >= 70 then 0.9::double when cwe <> '' then 0.5::double else 0.3::double end + {sev.sql_case('severity', sev.GATE_BONUS, 0.0)}::double
      + least(confirmations * 0.1::double, 0.3::double) + case when line > 0 then 0.1::double else 0.0::double end - case when known_fp then 0.4::double else 0.0::double end - case when noise then 0.3::double else 0.0::double end - 0.2::double)), 4) as confidence from g),
t as (select *, case when confidence >= 0.7 then 'high' when confidence >= 0.4 then 'medium' else 'low' end as tier from c)
select file, cwe, severity, confidence, tier, case when tier = 'high' and (noise or confirmations < 2) then 'ai_analyze' when tier = 'high' then 'defend' when tier = 'medium' then 'ai_analyze'
  when severity in ('critical', 'high') then 'human_review' else 'discard' end as routing from t"""


def routing_rollup(spark, sf_dir):
    """The flagship: lines to findings to merged, scored and routed groups, rolled up."""
    return gate(spark, sf_dir).groupBy("severity", "tier", "routing").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def secret_verdicts(spark, sf_dir):
    """Credential values judged by length, entropy and character classes; shown by four characters only."""
    f = findings(spark, sf_dir).where("type = 'credential'")
    value = F.regexp_extract("message", r"[:=] *([^ ]+)$", 1)
    f = f.select("doc_id", "line", value.alias("value")).withColumn("entropy", entropy(F.col("value"))).withColumn("classes", classes(F.col("value")))
    n = F.length("value")
    verdict = F.when(n < 8, "clean").when((n >= 20) & (F.col("entropy") >= 3.5) & (F.col("classes") >= 3), "critical").when((n >= 12) & (F.col("entropy") >= 3.0), "high").otherwise("clean")
    return f.select("doc_id", "line", keep_four(F.col("value")).alias("shown"), "entropy", "classes", verdict.alias("verdict"))


SECRET_SQL = "with " + FINDINGS_SQL + r""", v as (select doc_id, line, regexp_extract(message, '[:=] *([^ ]+)$', 1) as value from findings where type = 'credential'),
e as (select *, case when length(value) > 0 then round(list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: -((length(value) - length(replace(value, c, '')))::double / length(value)) * log2((length(value) - length(replace(value, c, '')))::double / length(value)))), 3) else 0 end as entropy,
  regexp_matches(value, '[A-Z]')::int + regexp_matches(value, '[a-z]')::int + regexp_matches(value, '[0-9]')::int + regexp_matches(value, '[^A-Za-z0-9]')::int as classes from v)
select doc_id, line, case when length(value) <= 4 then '[REDACTED]' else substr(value, 1, 4) || '…[REDACTED]' end as shown, entropy, classes,
  case when length(value) < 8 then 'clean' when length(value) >= 20 and entropy >= 3.5 and classes >= 3 then 'critical' when length(value) >= 12 and entropy >= 3.0 then 'high' else 'clean' end as verdict from e"""


def redacted_lines(spark, sf_dir):
    f = lines(table(spark, sf_dir, "documents"))
    out = F.regexp_replace("body", RULES[0][4], "[EMAIL]")
    out = F.regexp_replace(out, r"(?i)((?:password|passwd|secret|token|api_?key) *[:=] *)[^ ]+", "$1[REDACTED]")
    return f.select("doc_id", "line", out.alias("redacted"), "body").where("redacted <> body").drop("body")


def license_classes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    names = F.element_at(F.array(*map(F.lit, ["MIT", "GPL-3.0-or-later", "Apache-2.0", "", "AGPL-3.0-only", "weird", "lgpl-2.1", "ISC"])), (F.col("p_partkey") % 8 + 1).cast("int"))
    return p.select(F.col("p_brand").alias("brand"), license_status(names).alias("status")).groupBy("brand", "status").agg(F.count(F.lit(1)).alias("n"))


LICENSE_SQL = """with p as (select p_brand as brand, replace(replace(lower(trim(['MIT', 'GPL-3.0-or-later', 'Apache-2.0', '', 'AGPL-3.0-only', 'weird', 'lgpl-2.1', 'ISC'][p_partkey % 8 + 1])), '-or-later', ''), '-only', '') as l from part)
select brand, case when l = '' then 'missing' when l in ('gpl-3.0', 'agpl-3.0') then 'restricted' when l in ('mit', 'apache-2.0', 'isc') then 'allowed' when contains(l, 'gpl') then 'restricted' else 'unknown' end as status, count(*) as n from p group by all"""


def baseline_diff(spark, sf_dir):
    """New and resolved findings by fingerprint; even documents are the baseline, odd ones the current scan."""
    key = F.substring(F.sha2(F.concat_ws(":", "type", "severity", "message"), 256), 1, 16)
    f = findings(spark, sf_dir).withColumn("fingerprint", key)
    old, new = f.where("doc_id % 2 = 0").select("fingerprint", "type").distinct(), f.where("doc_id % 2 = 1").select("fingerprint", "type").distinct()
    both = old.withColumn("o", F.lit(1)).join(new.withColumn("n", F.lit(1)), ["fingerprint", "type"], "full_outer")
    state = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "resolved").otherwise("unchanged")
    return both.select("fingerprint", "type", state.alias("state"))


def heatmap(spark, sf_dir):
    """Findings rolled up over every folder prefix; top 20."""
    f = findings(spark, sf_dir).withColumn("rank", sev.rank(F.col("severity")))
    parts = F.split("file", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    g = f.groupBy(F.col("file")).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank")).withColumn("prefix", F.explode(prefixes))
    return g.groupBy("prefix").agg(F.sum("n").alias("n"), F.min("rank").alias("worst")).orderBy(F.desc("n"), "prefix").limit(20)


def sarif_results(spark, sf_dir):
    """One result object a finding, as JSON; findings without a file would be left out."""
    f = findings(spark, sf_dir).where("file is not null and file <> ''")
    body = F.to_json(F.struct(F.col("type").alias("ruleId"), sev.lookup(F.col("severity"), sev.SARIF_LEVEL, "note").alias("level"), F.struct(F.col("file").alias("uri"), F.col("line").alias("startLine")).alias("location")))
    return f.select("file", "line", "type", body.alias("result"))


def policy_violations(spark, sf_dir):
    """Policy packs as data: each control names a content check; violations by pack and control."""
    packs = [("soc2", "CC6.1", "credential"), ("soc2", "CC6.7", "email"), ("hipaa", "164.312", "ssn"), ("hipaa", "164.312b", "phone"), ("pci_dss", "3.4", "card"), ("pci_dss", "8.2", "credential"), ("cis", "4.1", "ip_address")]
    rules = spark.createDataFrame(packs, "pack string, control string, type string")
    f = findings(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))
    return rules.join(f, "type", "left").select("pack", "control", F.coalesce("n", F.lit(0)).alias("violations"), F.coalesce("files", F.lit(0)).alias("files"), F.col("n").isNull().alias("passed"))


POLICY_SQL = "with " + FINDINGS_SQL + """, p(pack, control, type) as (values ('soc2','CC6.1','credential'),('soc2','CC6.7','email'),('hipaa','164.312','ssn'),('hipaa','164.312b','phone'),('pci_dss','3.4','card'),('pci_dss','8.2','credential'),('cis','4.1','ip_address')),
c as (select type, count(*) n, count(distinct file) files from findings group by type)
select pack, control, coalesce(n, 0) as violations, coalesce(files, 0) as files, n is null as passed from p left join c on p.type = c.type"""


def suppressed(spark, sf_dir):
    """Ignore comments hold for their line and the next; here every 7th document ignores line 2."""
    f = findings(spark, sf_dir)
    ignores = table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select("doc_id", F.explode(F.array(F.lit(2).cast("long"), F.lit(3).cast("long"))).alias("line")).distinct()
    return f.join(ignores, ["doc_id", "line"], "left_anti").groupBy("type").agg(F.count(F.lit(1)).alias("kept"))


def line_groups(rows: DataFrame, keys: list[str], tolerance: int = 5) -> DataFrame:
    """Rows of one key within ``tolerance`` lines of a group's first line are one group; that line does not move."""

    def step(groups, line):
        if groups and line - groups[-1][0] <= tolerance:
            groups[-1][1] += 1
        else:
            groups.append([line, 1])
        return groups

    return fold_groups(rows, keys, ["line"], ["line"], list, step, lambda groups: [tuple(g) for g in groups], "first_line long, n long")


def tolerance_groups(spark, sf_dir):
    return line_groups(findings(spark, sf_dir), ["file", "cwe"])


TOLERANCE_SQL = "with recursive " + FINDINGS_SQL + """, o as (select file, cwe, line, row_number() over (partition by file, cwe order by line) as r from findings),
w as (select file, cwe, line, r, line as first_line from o where r = 1
  union all select o.file, o.cwe, o.line, o.r, case when o.line - w.first_line <= 5 then w.first_line else o.line end from w join o on o.file = w.file and o.cwe = w.cwe and o.r = w.r + 1)
select file, cwe, first_line, count(*) as n from w group by all"""


def _q(body: str) -> str:
    return "with " + FINDINGS_SQL + " " + body


QUERIES = {
    "scan_findings": (scan_findings, _q("select * from findings")),
    "severity_counts": (severity_counts, _q(f"select severity, count(*) as n, count(distinct file) as files, {sev.RANK_SQL.format('severity')} as rank from findings group by severity")),
    "counts_by_agent_and_type": (counts_by_agent_and_type, _q("select agent, type, severity, count(*) as n from findings group by all")),
    "worst_first_page": (worst_first_page, _q(f"select severity, file, line, type, (select count(*) from findings) as total from findings order by {sev.RANK_SQL.format('severity')}, file, line, type limit 50 offset 50")),
    "noise_report": (noise_report, _q(f"select coalesce({NOISE_SQL}, 'source') as category, count(*) as n, count(*) filter (severity <> 'info' and {NOISE_SQL} is not null) as capped from findings group by 1")),
    "noise_capped": (noise_capped, _q(f"select file, line, type, case when {NOISE_SQL} is not null then 'info' else severity end as severity, {NOISE_SQL} as noise_category from findings")),
    "merged_findings": (merged, "with " + MERGED_SQL + f" select file, cwe, confirmed_by, confirmations, line, n, severity, {SCORE_SQL} as score from merged"),
    "owasp_rollup": (owasp_rollup, _q(f"select {sev.sql_case('cwe', OWASP, 'A05 Security Misconfiguration')} as category, count(*) as n from findings group by 1")),
    "confidence_gate": (gate, "with " + GATE_SQL),
    "routing_rollup": (routing_rollup, f"with x as (with {GATE_SQL}) select severity, tier, routing, count(*) as n, round(avg(confidence), 6) as mean_confidence from x group by all"),
    "secret_verdicts": (secret_verdicts, SECRET_SQL),
    "redacted_lines": (redacted_lines, "with " + LINES_SQL + r""" select * from (select doc_id, line, regexp_replace(regexp_replace(body, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', '[EMAIL]', 'g'), '(?i)((?:password|passwd|secret|token|api_?key) *[:=] *)[^ ]+', '\1[REDACTED]', 'g') as redacted from lines where true) r where (doc_id, line, redacted) not in (select (doc_id, line, body) from lines)"""),
    "license_classes": (license_classes, LICENSE_SQL),
    "baseline_diff": (baseline_diff, _q(""", f as (select *, substr(sha256(concat_ws(':', type, severity, message)), 1, 16) as fingerprint from findings),
o as (select distinct fingerprint, type from f where doc_id % 2 = 0), n as (select distinct fingerprint, type from f where doc_id % 2 = 1)
select coalesce(o.fingerprint, n.fingerprint) as fingerprint, coalesce(o.type, n.type) as type, case when o.type is null then 'new' when n.type is null then 'resolved' else 'unchanged' end as state
from o full join n on o.fingerprint = n.fingerprint and o.type = n.type""")),
    "heatmap_top": (heatmap, _q(f""", g as (select file, count(*) as n, min({sev.RANK_SQL.format('severity')}) as rank, string_split(file, '/') as p from findings group by file),
e as (select array_to_string(p[1:unnest(range(1, len(p) + 1))], '/') as prefix, n, rank from g) select prefix, sum(n)::bigint as n, min(rank) as worst from e group by prefix order by n desc, prefix limit 20""")),
    "sarif_results": (sarif_results, _q(f"""select file, line, type, '{{"ruleId":"' || type || '","level":"' || {sev.sql_case('severity', sev.SARIF_LEVEL, 'note')} || '","location":{{"uri":"' || file || '","startLine":' || line || '}}}}' as result from findings""")),
    "policy_violations": (policy_violations, POLICY_SQL),
    "suppressed_findings": (suppressed, _q("select type, count(*) as kept from findings where not (doc_id % 7 = 0 and line in (2, 3)) group by type")),
    "tolerance_groups": (tolerance_groups, TOLERANCE_SQL),
}
