"""Detection rules as data, compiled to column predicates.

A rule has named selections (field tests) and a condition over their names. The condition is read by a
small recursive descent into one boolean Column, so a rule set of any size is one projection.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.windows import ENTRIES_SQL, log

RULES = [
    {"id": "R1", "level": "high", "selections": {"err": {"event_type": "error"}, "big": {"value|gte": 50}}, "condition": "err and big"},
    {"id": "R2", "level": "medium", "selections": {"a": {"path|startswith": "/view/"}, "b": {"path|endswith": "7"}, "c": {"status|lt": 400}}, "condition": "(a or b) and not c"},
    {"id": "R3", "level": "low", "selections": {"sel_1": {"event_type": ["click", "view"]}, "sel_2": {"method": "POST"}, "sel_3": {"path|contains": "/1"}}, "condition": "2 of sel_*"},
    {"id": "R4", "level": "critical", "selections": {"x": {"ip|cidr": "10.0.0.64/26"}, "y": {"path|re": "^/(error|signup)/[0-9]$"}}, "condition": "all of them"},
    {"id": "R5", "level": "info", "selections": {"x": {"path": "/p*/*3"}, "y": {"value|gt": 99.5}}, "condition": "1 of them"},
]


def _in_ipv6(network: str):
    """Whether addresses lie in an IPv6 network: no built-in expression reads its notations."""
    import ipaddress

    import pandas as pd

    net = ipaddress.ip_network(network, strict=False)

    def inside(address: str | None) -> bool:
        try:
            return address is not None and ipaddress.ip_address(address) in net
        except ValueError:
            return False

    return F.pandas_udf(lambda s: s.map(inside).astype(bool) if len(s) else pd.Series(dtype=bool), "boolean")


def _one(field: Column, modifier: str, value: object) -> Column:
    if modifier in ("gt", "lt", "gte", "lte"):
        number = field.cast("double")
        return {"gt": number > value, "lt": number < value, "gte": number >= value, "lte": number <= value}[modifier]
    text = field.cast("string")
    if modifier == "base64":
        return F.try_to_binary(text, F.lit("base64")).cast("string").contains(str(value))
    if modifier == "cidr" and ":" in str(value):
        return _in_ipv6(str(value))(text)
    if modifier == "cidr":
        base, bits = str(value).split("/")
        size = 2 ** (32 - int(bits))
        low = reduce(lambda a, b: a * 256 + int(b), base.split("."), 0) // size * size
        octets = F.split(text, r"\.")
        number = reduce(lambda a, i: a * 256 + F.get(octets, i).cast("long"), range(4), F.lit(0).cast("long"))
        return number.between(low, low + size - 1)
    if modifier in ("contains", "startswith", "endswith"):
        return getattr(text, modifier)(str(value))
    if modifier == "re":
        return text.rlike(str(value))
    if "*" in str(value):
        return text.rlike("^" + ".*".join(re.escape(p) for p in str(value).split("*")) + "$")
    return text == str(value)


def selection(tests: dict) -> Column:
    """All field tests hold; of a list of values any one."""
    parts = []
    for key, value in tests.items():
        field, _, modifier = key.partition("|")
        options = value if isinstance(value, list) else [value]
        parts.append(reduce(lambda a, b: a | b, (_one(F.col(field), modifier, v) for v in options)))
    return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))


def condition(text: str, selections: dict[str, Column]) -> Column:
    """``and``, ``or``, ``not``, parentheses, and ``all|any|N of them|prefix*`` over selection names."""
    words = re.findall(r"\(|\)|[\w*]+", text)
    at = 0

    def peek() -> str:
        return words[at].lower() if at < len(words) else ""

    def take() -> str:
        nonlocal at
        if at >= len(words):
            raise ValueError(f"condition ends early: {text}")
        at += 1
        return words[at - 1]

    def either() -> Column:
        out = both()
        while peek() == "or":
            take()
            out = out | both()
        return out

    def both() -> Column:
        out = term()
        while peek() == "and":
            take()
            out = out & term()
        return out

    def term() -> Column:
        word = take()
        if word.lower() == "not":
            return ~term()
        if word == "(":
            out = either()
            if take() != ")":
                raise ValueError(f"missing bracket: {text}")
            return out
        if peek() == "of":
            take()
            of = take()
            chosen = [c for n, c in selections.items() if of.lower() == "them" or n.startswith(of.rstrip("*"))]
            need = len(chosen) if word.lower() == "all" else 1 if word.lower() == "any" else int(word)
            return reduce(lambda a, c: a + c.cast("int"), chosen, F.lit(0)) >= need
        if word not in selections:
            raise ValueError(f"no selection {word} in: {text}")
        return selections[word]

    out = either()
    if at < len(words):
        raise ValueError(f"cannot read the rest of: {text}")
    return out


def match(rows: DataFrame, rules: list[dict]) -> DataFrame:
    """The rows with one copy for each rule that they match: rule_id, level."""
    tests = [F.when(condition(r["condition"], {n: selection(t) for n, t in r["selections"].items()}), F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["level"]).alias("level"))) for r in rules]
    return rows.withColumn("rule", F.explode(F.array_compact(F.array(*tests)))).select(*rows.columns, "rule.rule_id", "rule.level")


def load_rules(texts: Iterable[tuple[str, str]]) -> tuple[list[dict], list[tuple[str, str]]]:
    """(rules, skipped) of named JSON texts, one rule or a list of rules each; bad ones are named with the reason.

    A rule needs an id, selections and a condition that can be compiled; ``level`` is medium by default.
    Rule sets are read on the driver: they are configuration, not data.
    """
    rules, skipped = [], []
    for name, text in texts:
        try:
            read = json.loads(text)
            for r in read if isinstance(read, list) else [read]:
                condition(r["condition"], {n: selection(t) for n, t in r["selections"].items()})
                rules.append({"id": str(r["id"]), "level": r.get("level", "medium"), "selections": r["selections"], "condition": r["condition"]})
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            skipped.append((name, f"{type(e).__name__}: {e}"))
    return rules, skipped


def load_rule_folder(spark, folder: str) -> tuple[list[dict], list[tuple[str, str]]]:
    """``load_rules`` of all JSON files of a folder, through Spark's readers."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value").orderBy("path")
    return load_rules((r["path"], r["value"]) for r in files.collect())


def rule_matches(spark, sf_dir):
    return match(log(spark, sf_dir), RULES).select("event_id", "rule_id", "level")


def rule_summary(spark, sf_dir):
    m = match(log(spark, sf_dir), RULES)
    return m.groupBy("rule_id", "level").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ip").alias("ips"), F.min("event_id").alias("first_event"))


def dispatch(spark, sf_dir):
    """Urgency of events: critical rules block, high ones go at once, a mapped rest is batched, others to triage."""
    m = match(log(spark, sf_dir), RULES).groupBy("event_id").agg(F.min(F.when(F.col("level") == "critical", 0).when(F.col("level") == "high", 1).when(F.col("level") == "medium", 2).when(F.col("level") == "low", 3).otherwise(4)).alias("worst"))
    route = F.when(F.col("worst") == 0, "sync_block").when(F.col("worst") == 1, "immediate").when(F.col("worst") <= 3, "batched").otherwise("triage")
    return m.groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"))


def quiet_hours(spark, sf_dir):
    """Events held back between 22:00 and 07:30, errors excepted."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    quiet = ((minute >= 22 * 60) | (minute < 7 * 60 + 30)) & (F.col("status") < 500)
    return log(spark, sf_dir).groupBy("event_type").agg(F.count_if(quiet).alias("held"), F.count_if(~quiet).alias("sent"))


_MATCH = f"""{ENTRIES_SQL}, m as (
  select *, 'R1' as rule_id, 'high' as level from entries where event_type = 'error' and value >= 50
  union all select *, 'R2', 'medium' from entries where (starts_with(path, '/view/') or ends_with(path, '7')) and not status < 400
  union all select *, 'R3', 'low' from entries where (event_type in ('click', 'view'))::int + (method = 'POST')::int + contains(path, '/1')::int >= 2
  union all select *, 'R4', 'critical' from entries where string_split(ip, '.')[4]::int between 64 and 127 and regexp_matches(path, '^/(error|signup)/[0-9]$')
  union all select *, 'R5', 'info' from entries where (regexp_matches(path, '^/p.*/.*3$') or value > 99.5))"""
QUERIES = {
    "rule_matches": (rule_matches, f"with {_MATCH} select event_id, rule_id, level from m"),
    "rule_summary": (rule_summary, f"with {_MATCH} select rule_id, level, count(*) as n, count(distinct ip) as ips, min(event_id) as first_event from m group by all"),
    "dispatch_routes": (dispatch, f"with {_MATCH}, w as (select event_id, min(case level when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end) as worst from m group by 1) select case when worst = 0 then 'sync_block' when worst = 1 then 'immediate' when worst <= 3 then 'batched' else 'triage' end as route, count(*) as n from w group by 1"),
    "quiet_hours": (quiet_hours, f"with {ENTRIES_SQL}, q as (select *, (hour(ts) * 60 + minute(ts) >= 1320 or hour(ts) * 60 + minute(ts) < 450) and status < 500 as quiet from entries) select event_type, count(*) filter (quiet) as held, count(*) filter (not quiet) as sent from q group by 1"),
}
