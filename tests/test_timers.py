import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming.timers import escalations, limited, triage

AT = 1_700_000_000


class Clock:
    """A folder that a query reads a file a batch; each file may move the watermark on."""

    def __init__(self, spark, path, schema, operator, name):
        self.spark, self.path, self.schema, self.operator, self.name = spark, path, schema, operator, name

    def feed(self, *files):
        for rows in files:
            df = self.spark.createDataFrame(rows, self.schema).withColumn("ts", F.timestamp_millis(F.round(F.col("s") * 1000).cast("long") + AT * 1000)).drop("s")
            df.coalesce(1).write.mode("append").parquet(str(self.path / "in"))
            self.kind = df.schema

    def run(self):
        """Everything up to now, in batches of a file; a later call goes on from the checkpoint."""
        stream = self.spark.readStream.schema(self.kind).option("maxFilesPerTrigger", 1).parquet(str(self.path / "in")).withWatermark("ts", "0 seconds")
        q = self.operator(stream).writeStream.format("parquet").option("path", str(self.path / "out")).option("checkpointLocation", str(self.path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return self.spark.read.parquet(str(self.path / "out")).collect()


@pytest.fixture
def clock(spark, tmp_path):
    return lambda schema, operator: Clock(spark, tmp_path, schema, operator, "q")


def test_escalation_after_thirty_minutes_and_purge(clock):
    c = clock("alert_id string, s double, severity string, acked boolean", escalations)
    c.feed([("a", 0.0, "high", False), ("b", 0.0, "critical", False), ("c", 0.0, "low", False), ("d", 0.0, "high", False)], [("b", 1799.0, None, True), ("x", 1700.0, "low", False)])
    assert c.run() == []  # nothing is due yet
    c.feed([("d", 1900.0, None, True), ("x", 1801.0, "low", False)], [("x", 1900.0, "low", False)])
    got = {(r["alert_id"], r["due"].timestamp() - r["fired"].timestamp()) for r in c.run()}
    assert got == {("a", 1800.0), ("d", 1800.0)}  # d was acknowledged too late, b in time, c is not urgent
    c.feed([("a", 2000.0, "high", False), ("x", 3000.0, "low", False)], [("x", 72 * 3600 + 10.0, "low", False)], [("x", 72 * 3600 + 20.0, "low", False)], [("a", 72 * 3600 + 30.0, "high", False)], [("x", 75 * 3600.0, "low", False)], [("x", 75 * 3600 + 9.0, "low", False)])
    got = sorted((r["alert_id"], int(r["fired"].timestamp()) - AT) for r in c.run())
    assert got == [("a", 0), ("a", 72 * 3600 + 30), ("d", 0)]  # after the purge the alert is a new one


def test_sliding_limits(clock):
    r = random.Random(5)
    rows = sorted([(f"k{r.randrange(3)}", round(r.random() * 20, 3), k) for k in range(600)], key=lambda x: x[1])
    c = clock("k string, s double, id int", lambda df: limited(df, "k", most=7, seconds=1.0))
    c.feed(*[rows[k : k + 90] for k in range(0, 600, 90)])
    got = {x["id"] for x in c.run()}
    want, times = set(), {}
    for key, s, i in rows:
        ms = round(s * 1000)
        own = times[key] = [t for t in times.get(key, []) if t >= ms - 1000]
        if len(own) < 7:
            own.append(ms)
            want.add(i)
    assert got == want and 0 < len(got) < 600


def brute_triage(rows, end):
    out = set()
    for source in {s for s, _, _ in rows}:
        n, last, mean, var, seen, told, quiet = 0, 0.0, 0.0, 0.0, set(), {}, False
        for at, technique in [(t, x) for s, t, x in rows if s == source] + [(end, None)]:
            if n >= 5 and at - last > 300 and not quiet:
                out.add((source, round(last + 300, 3), "silence"))
                quiet = True
            if technique is None:
                continue
            rate = 1 / max(at - last, 1e-3) if n else 0.0
            found = []
            if n >= 5:
                found += ["rate_spike"] * (mean > 0 and rate > 10 * mean) + ["deviation"] * (var > 0 and abs(rate - mean) > 3 * math.sqrt(var)) + ["novelty"] * (technique not in seen | {"unknown"})
            for kind in found:
                if at - told.get(kind, -1e18) >= 30:
                    told[kind] = at
                    out.add((source, round(at, 3), kind))
            if n == 1:
                mean = rate
            elif n > 1:
                mean, var = mean + 0.2 * (rate - mean), 0.8 * (var + 0.2 * (rate - mean) ** 2)
            seen.add(technique)
            n, last, quiet = n + 1, at, False
    return out


def test_triage_of_sources(clock):
    r = random.Random(3)
    rows = []
    for source in ("a", "b", "c"):
        t = 0.0
        for k in range(60):
            t += r.choice([10.0, 12.0, 9.0, 11.0, 0.2 if k > 8 else 10.0, 700.0 if k % 20 == 19 else 10.0])
            rows.append((source, round(t, 3), r.choice(["T1", "T2", "T1", "unknown", f"N{k}" if k % 11 == 5 else "T1"])))
    rows.sort(key=lambda x: x[1])
    end = rows[-1][1] + 400
    c = clock("source string, s double, technique string", triage)
    c.feed(*[rows[k : k + 30] for k in range(0, 180, 30)], [("z", end, "T1")], [("z", end + 1, "T1")])
    got = {(x["source"], round(x["ts"].timestamp() - AT, 3), x["kind"]) for x in c.run()}
    assert got == brute_triage(rows, end) and {k for _, _, k in got} == {"silence", "rate_spike", "deviation", "novelty"}
