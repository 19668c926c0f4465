"""The live guard: log lines to entries, windowed detectors, keyed scores, and sinks.

Every operator takes and returns a streaming DataFrame, so a job is a composition of them; the batch
forms are in ``operators.windows``. Late rows beyond the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.severity import WATCH_POINTS
from tidemark.operators.windows import entries
from tidemark.plans.versions import VersionedTable, append_chain
from tidemark.sources.logs import parse_lines


def read_events(spark: SparkSession, folder: str, watermark: str = "10 minutes", files_per_trigger: int = 1) -> DataFrame:
    """New event files of a folder as entries with a watermark on their time."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return entries(events).withWatermark("ts", watermark)


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """New log files of a folder as entries."""
    return parse_lines(spark.readStream.text(folder))


def once(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once within the watermark."""
    return entries.dropDuplicatesWithinWatermark(keys)


def rate_windows(entries: DataFrame, width: str = "60 seconds", slide: str | None = None, least: int = 50) -> DataFrame:
    """Windows with more than ``least`` requests."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return entries.groupBy(w).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") >= 400).alias("errors")).where(F.col("n") > least)


def keyed_windows(entries: DataFrame, when: Column, width: str = "60 seconds", least: int = 20) -> DataFrame:
    """(ip, window) with at least ``least`` rows for which ``when`` holds."""
    return entries.where(when).groupBy("ip", F.window("ts", width)).agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= least)


def watch_scores(findings: DataFrame, ttl_seconds: int = 3600, high: float = 50, critical: float = 100) -> DataFrame:
    """Score of each address: points by detector, decaying linearly; one row for each escalation.

    ``findings``: ip, detector, ts with a watermark. State goes after ``ttl_seconds`` of silence.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, score, told = state.get if state.exists else (None, 0.0, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for ts, detector in zip(rows["ts"], rows["detector"], strict=True):
            now = ts.timestamp()
            score = score * max(0.0, 1.0 - max(0.0, now - last) / ttl_seconds) + WATCH_POINTS.get(detector, 0) if last is not None else float(WATCH_POINTS.get(detector, 0))
            last = now if last is None else max(last, now)
            reached = 2 if score >= critical else 1 if score >= high else 0
            if reached > told:
                told = reached
                out.append((key[0], ts, round(score, 6), "critical" if reached == 2 else "high"))
        state.update((last, score, told))
        state.setTimeoutTimestamp(int(max(last * 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1)))
        yield pd.DataFrame(out, columns=["ip", "ts", "score", "escalation"])

    return findings.groupBy("ip").applyInPandasWithState(update, "ip string, ts timestamp, score double, escalation string", "last double, score double, told int", "append", GroupStateTimeout.EventTimeTimeout)


#: What is kept of an address.
GUARD_FIELDS = ("posts", "opened", "paths", "last", "score", "told")
GUARD_STATE = "posts array<double>, opened double, paths array<string>, last double, score double, told int"
#: What no path of a request should contain.
PROBES = ("../", "/etc/passwd", "<script", "union select", "' or ", "${jndi:", "cmd.exe", "/wp-admin", "/.env", "%00")


def guarded(entries: DataFrame, *, seconds: int = 60, posts: int = 20, paths: int = 30, auth: str = "login|auth|token|session", probes: tuple[str, ...] = PROBES, blocked: DataFrame | None = None, ttl_seconds: int = 3600, high: float = 50, critical: float = 100) -> DataFrame:
    """The whole guard as one stateful operator over entries (ip, ts with a watermark, method, path, status).

    Each address keeps the times of its last ``posts`` posts to auth paths, the distinct paths since its window
    of ``seconds`` opened with the first arrival, and a score that decays linearly. One row for each finding
    (detector: brute_force, scanner_sweep, injection_probe, blocked_ip), with the score after it and the escalation that it
    caused, once each. ``blocked``: ip, a static table. State is bounded and goes after ``ttl_seconds`` of silence.
    """
    flags = entries.select("ip", "ts", ((F.col("method") == "POST") & F.lower("path").rlike(auth)).alias("post"), "path", F.exists(F.array(*map(F.lit, probes)), lambda p: F.lower("path").contains(p)).alias("probe"))
    if blocked is not None:
        flags = flags.join(blocked.select("ip").distinct().withColumn("blocked", F.lit(True)), "ip", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    else:
        flags = flags.withColumn("blocked", F.lit(False))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = dict(zip(GUARD_FIELDS, state.get, strict=True)) if state.exists else {"posts": [], "opened": None, "paths": [], "last": None, "score": 0.0, "told": 0}
        now["posts"], now["paths"] = list(now["posts"]), list(now["paths"])
        out = []
        for ts, post, path, probe, listed in pd.concat(list(batches)).sort_values("ts", kind="stable")[["ts", "post", "path", "probe", "blocked"]].itertuples(index=False):
            at, found = ts.timestamp(), []
            if listed:
                found.append("blocked_ip")
            if probe:
                found.append("injection_probe")
            if post:
                now["posts"] = [t for t in now["posts"] if at - t <= seconds][-(posts - 1) :] + [at]
                if len(now["posts"]) >= posts:
                    found.append("brute_force")
                    now["posts"] = []
            if now["opened"] is None or at - now["opened"] > seconds:
                now["opened"], now["paths"] = at, []
            if path is not None and len(now["paths"]) < paths and path not in now["paths"]:
                now["paths"].append(path)
                if len(now["paths"]) == paths:
                    found.append("scanner_sweep")
            for detector in found:
                aged = 0.0 if now["last"] is None else max(0.0, 1.0 - max(0.0, at - now["last"]) / ttl_seconds)
                now["score"] = now["score"] * aged + WATCH_POINTS.get(detector, 0)
                now["last"] = at if now["last"] is None else max(now["last"], at)
                reached = 2 if now["score"] >= critical else 1 if now["score"] >= high else 0
                told, now["told"] = now["told"], max(now["told"], reached)
                out.append((key[0], ts, detector, round(now["score"], 6), ("high", "critical")[reached - 1] if reached > told else None))
        state.update(tuple(now[f] for f in GUARD_FIELDS))
        state.setTimeoutTimestamp(max(int(at * 1000) + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["ip", "ts", "detector", "score", "escalation"]).astype({"detector": "object", "escalation": "object"})

    return flags.groupBy("ip").applyInPandasWithState(update, "ip string, ts timestamp, detector string, score double, escalation string", GUARD_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def traffic_spikes(entries: DataFrame, *, seconds: int = 60, rps: float = 50.0, least: int = 20, share: float = 0.4) -> DataFrame:
    """(ts, detector, severity, value) of windows of all traffic: rate_spike, more than ``rps`` requests a second; error_spike,
    more than ``share`` errors among more than ``least`` requests. ``ts`` is the window's end."""
    w = entries.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") >= 400).alias("errors"))
    one = lambda when, name, severity, value: F.when(when, F.struct(F.lit(name).alias("detector"), F.lit(severity).alias("severity"), value.alias("value")))
    found = F.array_compact(F.array(
        one(F.col("n") > rps * seconds, "rate_spike", "high", F.round(F.col("n") / seconds, 6)),
        one((F.col("n") > least) & (F.col("errors") > share * F.col("n")), "error_spike", "medium", F.round(F.col("errors") / F.col("n"), 6)),
    ))
    return w.select(F.col("w.end").alias("ts"), F.explode(found).alias("f")).select("ts", "f.*")


def reputations(reports: DataFrame) -> DataFrame:
    """(ip, sources, threat, blocked) of reports (ip, source): critical from five sources, high from three, which block."""
    n = reports.where("ip is not null").groupBy("ip").agg(F.countDistinct("source").alias("sources"))
    threat = F.when(F.col("sources") >= 5, "critical").when(F.col("sources") >= 3, "high").otherwise("low")
    return n.select("ip", "sources", threat.alias("threat"), (F.col("sources") >= 3).alias("blocked"))


def audited(table: VersionedTable, name: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that adds each row to a hash-chained audit table, once, whoever else writes to it.

    Entries are JSON with the query's ``name`` and epoch; an epoch that is in the table is not added again.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        before = table.read()
        mark = f'{{"query":"{name}","epoch":{epoch},'
        if before is not None and not before.where(F.col("body").startswith(mark)).isEmpty():
            return
        columns = [F.lit(name).alias("query"), F.lit(epoch).alias("epoch"), *batch.columns]
        rows = batch.select(F.to_json(F.struct(*columns)).alias("body"), *(["ts"] if "ts" in batch.columns else []))
        order = F.struct(*(["ts"] if "ts" in batch.columns else []), "body")
        if not rows.isEmpty():
            append_chain(table, rows.select(order.alias("nth"), "body"))

    return each


def hosted_guard(entries: DataFrame, audit: VersionedTable, checkpoint: str, *, reports: DataFrame | None = None, **options) -> list:
    """The whole guard over entries with a watermark on ts: writers of two queries whose findings meet in one audit chain.

    Findings of addresses (with blocking by ``reports``, watch scores and escalations) and of all traffic.
    """
    blocked = None if reports is None else reputations(reports).where("blocked")
    parts = {"guard": guarded(entries, blocked=blocked, **options), "traffic": traffic_spikes(entries)}
    return [df.writeStream.foreachBatch(audited(audit, name)).option("checkpointLocation", f"{checkpoint}/{name}") for name, df in parts.items()]


def fan_out(stream: DataFrame, sinks: dict[str, tuple[Column, Callable[[DataFrame, int], None]]], checkpoint: str):
    """One query that hands each micro-batch to every sink whose filter holds; a batch is read once."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for wanted, write in sinks.values():
                write(batch.where(wanted), epoch)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
