import shutil

from pyspark.sql import functions as F

from tidemark.operators.windows import entries
from tidemark.streaming.guard import fan_out, keyed_windows, once, rate_windows, read_events, watch_scores

SF = "/root/testdata/sf0.001"


def feed(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):  # every file twice: the second one holds only repeats
        shutil.copy(f"{SF}/events.parquet", folder / f"{k}.parquet")
    return str(folder)


def drain(stream, name, spark, tmp_path, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_repeats_pass_once(spark, tmp_path):
    got = drain(once(read_events(spark, feed(tmp_path), "40 days"), ["event_id"]), "once", spark, tmp_path)
    assert len(got) == len({r["event_id"] for r in got}) == spark.read.parquet(f"{SF}/events.parquet").count()


def test_windows_equal_their_batch_form(spark, tmp_path):
    folder = feed(tmp_path)
    batch = entries(spark.read.parquet(folder))
    want = {(r["ip"], r["window"]["start"], r["hits"]) for r in keyed_windows(batch, F.col("method") == "POST", "1 day", 3).collect()}
    got = drain(keyed_windows(read_events(spark, folder, files_per_trigger=2), F.col("method") == "POST", "1 day", 3), "keyed", spark, tmp_path, "complete")
    assert want and {(r["ip"], r["window"]["start"], r["hits"]) for r in got} == want
    rates = drain(rate_windows(read_events(spark, folder, files_per_trigger=2), "1 day", least=10), "rates", spark, tmp_path, "complete")
    assert len(rates) == rate_windows(batch, "1 day", least=10).count() > 0


def test_scores_escalate_once_each(spark, tmp_path):
    folder = str(tmp_path / "hits")
    rows = [("1.1.1.1", "brute_force", k * 10) for k in range(4)] + [("2.2.2.2", "error_spike", k * 3000) for k in range(20)]
    df = spark.createDataFrame(rows, "ip string, detector string, s long").select("ip", "detector", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    df.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder).withWatermark("ts", "1 day")
    got = drain(watch_scores(stream), "scores", spark, tmp_path)
    assert [(r["ip"], r["escalation"]) for r in got] == [("1.1.1.1", "high"), ("1.1.1.1", "critical")]


def test_fan_out_reads_a_batch_once(spark, tmp_path):
    seen = {"bad": 0, "all": 0}

    def count(name):
        return lambda df, epoch: seen.__setitem__(name, seen[name] + df.count())

    stream = read_events(spark, feed(tmp_path))
    fan_out(stream, {"bad": (F.col("status") >= 400, count("bad")), "all": (F.lit(True), count("all"))}, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert seen["all"] == 2 * spark.read.parquet(f"{SF}/events.parquet").count() and 0 < seen["bad"] < seen["all"]


def test_sinks(spark, tmp_path):
    import hashlib

    from tidemark.streaming.sinks import newest, sarif, signed, verify_chain

    f = spark.createDataFrame([("a.py", 3, "email", "high", "m"), ("b.py", 1, "email", "low", "n"), (None, 1, "card", "high", "o")], "file string, line int, type string, severity string, message string")
    sarif(f, str(tmp_path / "sarif"))
    assert [r["id"] for r in spark.read.json(str(tmp_path / "sarif/rules")).collect()] == ["email"]
    assert sorted(r["level"] for r in spark.read.json(str(tmp_path / "sarif/results")).collect()) == ["error", "note"]

    assert [r["line"] for r in newest(f, ["type"], [F.desc("line")], 1).where("type = 'email'").collect()] == [3]

    rows, before = [], ""
    for k in range(5):
        h = hashlib.sha256((before + f"b{k}").encode()).hexdigest()
        rows.append(("l", k, f"b{k}", before, h))
        before = h
    schema = "log string, seq int, body string, previous_hash string, entry_hash string"
    assert verify_chain(spark.createDataFrame(rows, schema)).count() == 0
    rows[2] = (*rows[2][:2], "forged", *rows[2][3:])
    assert [r["seq"] for r in verify_chain(spark.createDataFrame(rows, schema)).collect()] == [2]

    rows[2] = ("l", 2, "b2", *rows[2][3:])
    for bad in ((*rows[4][:4], None), (*rows[4][:3], None, rows[4][4]), (*rows[4][:2], None, *rows[4][3:])):  # nothing missing passes
        assert [r["seq"] for r in verify_chain(spark.createDataFrame([*rows[:4], bad], schema)).collect()] == [4]

    got = signed(spark.createDataFrame([("x",), (None,)], "body string"), "key").collect()
    assert len(got[0]["signature"]) == 64 and got[1]["signature"] is None


def test_guard_finds_scores_and_escalates(spark, tmp_path):
    from tidemark.streaming.guard import guarded

    at = 1_700_000_000
    rows = [("1.1.1.1", "POST", "/login", at + k) for k in range(25)] + [("2.2.2.2", "GET", f"/p{k}", at + k) for k in range(40)] + [("3.3.3.3", "GET", "/a/../../etc/passwd", at), ("4.4.4.4", "GET", "/", at), ("5.5.5.5", "GET", f"/q", at + 1)]
    rows += [("6.6.6.6", "GET", f"/p{k}", at + 10 * k) for k in range(40)] + [("3.3.3.3", "GET", "/.env", at + 5)]
    df = spark.createDataFrame(rows, "ip string, method string, path string, s long").select("ip", "method", "path", F.lit(200).alias("status"), F.timestamp_seconds("s").alias("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "guard-in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "guard-in")).withWatermark("ts", "1 day")
    got = drain(guarded(stream, blocked=spark.createDataFrame([("4.4.4.4",)], "ip string")), "guard", spark, tmp_path)
    found = sorted(((r["ip"], r["detector"], r["escalation"]) for r in got), key=str)
    assert [(i, d) for i, d, _ in found] == [("1.1.1.1", "brute_force"), ("2.2.2.2", "scanner_sweep"), ("3.3.3.3", "injection_probe"), ("3.3.3.3", "injection_probe"), ("4.4.4.4", "blocked_ip")]
    assert {r["score"] for r in got if r["ip"] == "1.1.1.1"} == {40.0}
    assert [e for i, _, e in found if e] == ["high"] and max(r["score"] for r in got if r["ip"] == "3.3.3.3") > 59


def test_the_hosted_guard_ends_in_one_audit_chain(spark, tmp_path):
    import json

    from tidemark.plans.versions import VersionedTable
    from tidemark.streaming.guard import audited, hosted_guard, reputations
    from tidemark.streaming.sinks import verify_chain

    at = 1_700_000_040
    rows = [("1.1.1.1", "POST", "/login", at + k, 200) for k in range(22)] + [("2.2.2.2", "GET", f"/q{k % 5}", at + k % 50, 500 if k % 3 else 200) for k in range(60)] + [("3.3.3.3", "GET", "/x", at + 1, 200)]
    rows += [("4.4.4.4", "GET", f"/a{k % 7}", at + 120 + k % 55, 200) for k in range(3100)] + [("5.5.5.5", "GET", "/", at + 900, 200)]
    df = spark.createDataFrame(rows, "ip string, method string, path string, s long, status int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.where(F.col("ts") < F.timestamp_seconds(F.lit(at + 600))).coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where(F.col("ts") > F.timestamp_seconds(F.lit(at + 600))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    reports = spark.createDataFrame([("3.3.3.3", f"list {k}") for k in range(3)] + [("2.2.2.2", "list 0"), ("2.2.2.2", "list 0"), (None, "x")], "ip string, source string")
    assert {r["ip"]: (r["sources"], r["threat"], r["blocked"]) for r in reputations(reports).collect()} == {"3.3.3.3": (3, "high", True), "2.2.2.2": (1, "low", False)}
    audit = VersionedTable(spark, str(tmp_path / "audit"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "10 seconds")
    running = [w.trigger(availableNow=True).start() for w in hosted_guard(stream, audit, str(tmp_path / "cp"), reports=reports)]
    for q in running:
        q.awaitTermination()
    log = audit.read()
    found = [json.loads(r["body"]) for r in log.collect()]
    assert verify_chain(log.withColumn("log", F.lit("l"))).count() == 0
    assert {(f.get("ip"), f["detector"]) for f in found} >= {("1.1.1.1", "brute_force"), ("3.3.3.3", "blocked_ip"), (None, "error_spike"), (None, "rate_spike")}
    n = len(found)
    first = next(f for f in found if f["query"] == "guard")
    audited(audit, "guard")(spark.createDataFrame([("9.9.9.9", "again")], "ip string, detector string"), first["epoch"])  # a repeated epoch adds nothing
    assert audit.read().count() == n
