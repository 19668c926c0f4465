import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import graph
from tidemark.operators.chains import chain_links, exploit_chains, role, worst_chains
from tidemark.operators.graph import closure, symbol_risk
from tidemark.operators.ignores import glob_regex, ignore_comments, longest_match, suppress
from tidemark.operators.joins import nearest
from tidemark.operators.lifecycle import deltas, known_flags, merge_results, proximity_groups, upsert_snapshot
from tidemark.operators.reports import soak_windows
from tidemark.operators.windows import decayed_scores, distinct_in_window, ewma_state, trailing_counts
from tidemark.plans.staging import stage
from tidemark.sources.trees import import_edges


def tuples(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_chains_escalate_and_end_at_impacts(spark):
    nodes = spark.createDataFrame(
        [(1, "a", "auth_missing", "medium", "x"), (2, "a", "sql_injection", "low", "y"), (3, "a", "hardcoded_secret", "low", "x"), (4, "b", "sql_injection", "low", "z"), (5, "c", "style", "low", "z"), (6, "b", "session_leak", "low", "z")],
        "id long, file string, type string, severity string, agent string",
    )
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    links = chain_links(nodes, edges)
    assert tuples(links, "u", "v") == [(1, 2), (1, 4), (2, 3), (4, 3)]
    got = {tuple(r["path"]): (r["severity"], r["score"]) for r in worst_chains(exploit_chains(nodes, links)).collect()}
    assert got == {(1, 2): ("high", 51), (1, 4): ("high", 51), (1, 2, 3): ("critical", 59), (1, 4, 3): ("critical", 59), (2, 3): ("high", 31), (4, 3): ("high", 31)}
    assert tuples(chain_links(nodes), "u", "v") == [(1, 2), (2, 3)]
    assert tuples(nodes.select("id", role(F.col("type")).alias("r")), "r")[-1] == ("standalone",)


def test_longest_pattern_wins_and_folders_come_first(spark):
    patterns = ["src/**", "src/gen/**", "**/*.min.js", "**/very_long_pattern_name_*"]
    cases = {"src/a.py": "src/**", "src/gen/a.py": "src/gen/**", "src": "src/**", "srcs/a.py": None, "x/y.min.js": "**/*.min.js", "y.min.js": "**/*.min.js", "src/very_long_pattern_name_1": "src/**"}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r["p"]: r["m"] for r in df.select("p", longest_match(F.col("p"), patterns).alias("m")).collect()} == cases
    assert glob_regex("a/*.t?t") == r"^a/[^/]*\.t[^/]t$"


def test_ignores_hold_for_their_lines_until_they_expire(spark):
    lines = [("a", 1, "# tidemark-ignore: email 2020-01-01"), ("b", 1, "// tidemark_ignore email"), ("c", 4, "x = 1  # TIDEMARK:ignore"), ("d", 2, "nothing"), ("e", 2, "# tidemark-ignore: sql 2030/05/06")]
    comments = ignore_comments(spark.createDataFrame(lines, "file string, line long, body string"))
    assert {(r["file"], r["line"], r["rule"], str(r["expires"])) for r in comments.collect()} == {("a", 1, "email", "2020-01-01"), ("b", 1, "email", "None"), ("c", 4, "*", "None"), ("e", 2, "sql", "2030-05-06")}
    rows = spark.createDataFrame([("a", 7, "email"), ("b", 9, "email_address"), ("b", 9, "phone"), ("c", 4, "x"), ("c", 5, "x"), ("c", 6, "x"), ("e", 3, "sql_injection"), ("e", 4, "sql_injection")], "file string, line long, type string")
    kept, gone, late = suppress(rows, comments, F.to_date(F.lit("2025-01-01")))
    assert tuples(gone, "file", "line") == [("b", 9), ("c", 4), ("c", 5), ("e", 3)]
    assert tuples(kept, "file", "line") == [("a", 7), ("b", 9), ("c", 6), ("e", 4)] and tuples(late, "file", "line") == [("a", 7)]


def test_proximity_joins_types_first_then_weaknesses(spark):
    rows = [("f", 10, "sql", "CWE-89"), ("f", 14, "sql", "CWE-89"), ("f", 13, "b608", "CWE-89"), ("f", 17, "sql", "CWE-89"), ("f", 30, "x", ""), ("f", 32, "y", ""), ("g", 11, "sql", "CWE-89")]
    got = tuples(proximity_groups(spark.createDataFrame(rows, "file string, line long, type string, cwe string")), "file", "line", "type", "anchor_line", "anchor_type")
    assert got == [("f", 10, "sql", 10, "sql"), ("f", 13, "b608", 10, "sql"), ("f", 14, "sql", 10, "sql"), ("f", 17, "sql", 17, "sql"), ("f", 30, "x", 30, "x"), ("f", 32, "y", 32, "y"), ("g", 11, "sql", 11, "sql")]


def test_life_cycle(spark):
    a = spark.createDataFrame([("x", "f", 1, "t")], "agent string, file string, line long, type string")
    b = spark.createDataFrame([("y", "f", 2, "t"), ("y", "g", 2, "t")], "agent string, file string, line long, type string")
    whole = merge_results(a, b.drop("line"), b)
    assert whole.count() == 5 and whole.where("line is null").count() == 2
    assert tuples(deltas(whole, b.limit(1)), "agent", "current", "baseline", "delta") == [("x", 1, 1, 0), ("y", 4, 1, 3)]
    assert tuples(known_flags(b, b.where("file = 'g'")), "file", "known_fp") == [("f", False), ("g", True)]
    state = spark.createDataFrame([("p", "1", 1, 1), ("q", "2", 1, 1)], "path string, hash string, first_seen int, last_seen int")
    scan = spark.createDataFrame([("q", "3", 5), ("r", "4", 5)], "path string, hash string, at int")
    assert tuples(upsert_snapshot(state, scan), "path", "hash", "first_seen", "last_seen", "drift") == [("p", "1", 1, 1, "gone"), ("q", "3", 1, 5, "changed"), ("r", "4", 5, 5, "added")]


def test_windows_and_folds(spark):
    s = 1_000_000
    rows = [("k", i, i * s, f"/{i % 3}", float(i)) for i in range(10)] + [("m", 99, 0, "/0", 5.0)]
    df = spark.createDataFrame(rows, "ip string, id long, us long, path string, value double")
    got = {r["id"]: r["n_values"] for r in distinct_in_window(df, "ip", "path", 1, 2).collect()}
    assert got == {i: 2 for i in range(1, 10)}
    assert {r["id"]: r["n_values"] for r in distinct_in_window(df, "ip", "path", 60, 3).collect()} == {i: 3 for i in range(2, 10)}
    assert tuples(ewma_state(df, ["ip"], ["us"], "value", 0.5).where("ip = 'm'"), "n", "mean", "variance") == [(1, 5.0, 0.0)]
    assert tuples(decayed_scores(df, ["ip"], ["us"], "us", "value", 2 * s).where("ip = 'm'"), "score", "peak") == [(5.0, 5.0)]


def test_trailing_counts_are_running_sums_over_spans(spark):
    rng, span = random.Random(8), 10_000_000
    times = [rng.choice([rng.randrange(-3 * span, 4 * span), rng.randrange(-3, 5) * span + rng.choice([-1, 0, 1]), None]) for _ in range(500)]
    rows = [(i, rng.choice(["a", "b", None]), us, rng.choice([1.0, 50.0, None])) for i, us in enumerate(times)]
    want = {}
    for i, key, us, _ in rows:
        near = [v for _, k, u, v in rows if k == key and (u is None if us is None else u is not None and us - span <= u <= us)]
        want[i] = (len(near), sum(v == 50.0 for v in near))
    df = spark.createDataFrame(rows, "id long, k string, us long, value double").repartition(3)
    out = trailing_counts(df, "k", 10, {"n": F.lit(True), "slow": F.col("value") > 35})
    assert out.columns == ["id", "k", "us", "value", "n", "slow"]
    assert {r["id"]: (r["n"], r["slow"]) for r in out.collect()} == want
    for plan in (out, soak_windows(spark, "/root/testdata/sf0.001")):  # a frame with a lower bound is read again for each row
        frames = re.findall(r"specifiedwindowframe\((\w+), ([^,]+),", plan._jdf.queryExecution().optimizedPlan().toString())
        assert frames and {low for _, low in frames} == {"unboundedpreceding$()"}


def test_nearest_takes_the_earlier_at_ties(spark):
    rows = [(1, "k", 10, "e"), (2, "k", 5, "b"), (3, "k", 15, "b"), (4, "k", 100, "e"), (5, "k", 99, "b"), (6, "k", 99, "b"), (7, "z", 1, "e"), (8, "k", 0, "e")]
    df = spark.createDataFrame(rows, "id long, u string, us long, t string")
    assert tuples(nearest(df, ["u"], "us", "id", F.col("t") == "e", F.col("t") == "b"), "id", "nearest", "gap") == [(1, 2, 5), (4, 5, 1), (8, 2, 5)]


def test_closures_have_no_cap_and_risks_follow(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 0)], "src long, dst long")
    assert closure(chain, seeds=spark.createDataFrame([(3,)], "src long")).count() == 12
    assert closure(chain, depth=2).count() == 26
    s = spark.createDataFrame([(5, 1.0, 0.8), (6, None, 0.3)], "id long, coverage double, criticality double")
    got = {r["id"]: (r["dependents"], r["score"], r["risk"]) for r in symbol_risk(chain, s, 5).collect()}
    assert got == {5: (5, round(0.04 + 0.15 + 0.24, 6), "medium"), 6: (5, round(0.04 + 0.3 * (1 - (0.5 + 0.2) / 2) + 0.09, 6), "medium")}


def uneven_graph(spark):
    """A ring with ways in and out of it, a thin random graph, repeated and null edges, nodes with an edge to themselves only; and the pairs of its closure."""
    rng = random.Random(5)
    ring, tail = [(i, (i + 1) % 12) for i in range(12)], [(4, 20), (20, 21), (21, 22), (30, 31), (31, 7), (40, 41), (41, 40)]
    thin = [(100 + rng.randrange(25), 100 + rng.randrange(25)) for _ in range(26)]
    rows = [*ring, *tail, *thin, (20, 21), (50, 50), (21, 21), (None, 3), (60, None)]
    pairs = {(u, v) for u, v in rows if u is not None and v is not None and u != v}
    known = set(pairs)
    while more := {(u, w) for u, v in known for x, w in pairs if v == x} - known:
        known |= more
    return spark.createDataFrame(rows, "src long, dst long"), {(u, v) for u, v in known if u != v}


def test_dependents_are_counted_from_components(spark, monkeypatch):
    df, known = uneven_graph(spark)
    counts = Counter(v for _, v in known if v % 2 == 0)
    assert tuples(graph.blast(df, "src % 2 = 0"), "node", "dependents", "risk") == sorted((v, n, "medium" if n <= 5 else "high") for v, n in counts.items())
    written = []
    monkeypatch.setattr(graph, "stage", lambda df, name: written.append((name, (out := stage(df, name)).count())) or out)
    ring = spark.createDataFrame([(i, (i + k) % 600) for i in range(600) for k in (1, 7)], "src long, dst long")
    assert tuples(graph.blast(ring).select("dependents").distinct(), "dependents") == [(599,)]
    assert max(n for name, n in written if name != "edges") <= 600  # nodes, never pairs of them


def test_reach_walks_between_components_and_makes_all_pairs(spark, monkeypatch):
    df, known = uneven_graph(spark)
    for name, value in (("SOURCES", 3), ("TARGETS", 2), ("PAIRS", 20)):
        monkeypatch.setattr(graph, name, value)
    assert tuples(graph.reach(df), "src", "dst") == sorted(known)
    assert tuples(graph.reach(df, spark.createDataFrame([(3,), (3,), (30,), (22,), (999,)], "src long")), "src", "dst") == sorted(p for p in known if p[0] in (3, 30))
    assert graph.reach(df.where("src = dst")).count() == 0
    monkeypatch.setattr(graph, "IN_TASK", 0)
    assert tuples(graph.reach(df, "src % 3 = 0"), "src", "dst") == sorted(p for p in known if p[0] % 3 == 0)


def test_pairs_of_a_large_component_are_made_once_by_many_tasks(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "stage", lambda df, name: written.append((name, (out := stage(df, name)).count())) or out)
    monkeypatch.setattr(graph, "PAIRS", 20_000)
    monkeypatch.setattr(graph, "TARGETS", 20)
    df = spark.createDataFrame([(i, (i + k) % 600) for i in range(600) for k in (1, 7)], "src long, dst long")
    out = graph.reach(df, "src % 2 = 0")
    assert max(n for name, n in written if name != "edges") <= 600
    assert out.groupBy("src").count().where("count <> 599").count() == 0 and out.distinct().count() == 300 * 599
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 2


def test_relative_imports_resolve(spark):
    files = spark.createDataFrame([("web/a.ts", "typescript", "import x from './b'\nimport y from '../lib/c'\n"), ("web/b.ts", "typescript", ""), ("lib/c.js", "javascript", "")], "path string, language string, content string")
    assert tuples(import_edges(files), "src", "dst") == [("web/a.ts", "lib/c.js"), ("web/a.ts", "web/b.ts")]


def test_telemetry(spark):
    from tidemark.operators.telemetry import agent_summary, breaches, coverage_facts, invariants, latency_series, module_name, subscribed, technique_hits

    rows = spark.createDataFrame([(k, float(k), 500 if k == 9 else 200) for k in range(10)], "s long, value double, status int").withColumn("ts", F.timestamp_seconds("s"))
    s = latency_series(rows, "ts", "value", "5 seconds")
    assert tuples(s, "n", "p50", "p95", "error_share") == [(5, 2.0, 4.0, 0.0), (5, 7.0, 9.0, 0.2)]
    assert breaches(s, 0.1, 100.0).count() == 1 and latency_series(rows, "ts", "value", "5 seconds", "1 second").count() == 14
    assert tuples(invariants(rows, {"small": F.col("value") < 8, "known": F.col("value").isNotNull()}), "invariant", "violations", "holds") == [("known", 0, True), ("small", 2, False)]
    f = spark.createDataFrame([("x", "a", "T1", "low"), ("x", "b", "T2", "critical"), ("y", "b", "T2", "high")], "source string, agent string, technique string, severity string")
    assert subscribed(f, sources=["x"], level="medium").count() == 1 and subscribed(f).count() == 3
    report = spark.createDataFrame([('{"files": {"a.py": {"executed_lines": [1, 2, 3], "missing_lines": [4]}, "b.py": {"executed_lines": [], "missing_lines": []}}}',), ("{broken",)], "value string")
    assert tuples(coverage_facts(report), "file", "covered", "lines", "share") == [("a.py", 3, 4, 0.75), ("b.py", 0, 0, None)]
    paths = spark.createDataFrame([("a/b/c/d.py",), ("a/x.py",), ("y.py",)], "p string")
    assert [r[0] for r in paths.select(module_name(F.col("p"))).collect()] == ["a.b", "a", "root"]
    hits = technique_hits(spark.createDataFrame([("r", "T1059.001"), ("q", "CWE-1")], "rule string, technique string"), spark.createDataFrame([(1, "uses T1059.001 twice T1059.001", ""), (2, None, "CWE-1")], "id int, message string, cwe string"))
    assert tuples(hits, "rule", "id") == [("q", 2), ("r", 1)]
    slow, wrong = agent_summary(spark.createDataFrame([("a", 5.0, 10, 9), ("b", 9.0, 2, 2), ("c", 1.0, 4, 1)], "agent string, p95 double, runs long, right long"), 2)
    assert [r["agent"] for r in slow.collect()] == ["b", "a"] and [r["agent"] for r in wrong.collect()] == ["c", "b"]


def test_nearest_is_one_pass_over_a_busy_key(spark):
    import bisect
    import random

    r = random.Random(2)
    rows = [(1, r.randrange(10**6), k, r.random() < 0.5) for k in range(30_000)]
    df = spark.createDataFrame(rows, "key int, at long, id long, asks boolean")
    got = {x["id"]: (x["nearest"], x["gap"]) for x in nearest(df, ["key"], "at", "id", F.col("asks"), ~F.col("asks")).collect()}
    offers = {}
    for _, at, i, asks in rows:
        if not asks:
            offers[at] = min(i, offers.get(at, i))
    times = sorted(offers)
    for _, at, i, asks in rows:
        if asks:
            k = bisect.bisect_left(times, at)
            best = min((abs(t - at), t) for t in times[max(0, k - 1) : k + 1])
            assert got[i] == (offers[best[1]], best[0])


def test_medians_from_counts(spark):
    from tidemark.operators.reports import medians

    df = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", 9.0), ("b", 1.0), ("b", 2.0), ("b", 2.0), ("b", 8.0), ("c", None), ("d", 3.0), ("d", 4.0)], "k string, v double")
    assert {x["k"]: x["middle"] for x in medians(df, "k", "v").collect()} == {"a": 5.0, "b": 2.0, "d": 3.5}
