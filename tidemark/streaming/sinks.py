"""Where findings go: SARIF, audit chain, retention, signed deliveries. For batches and ``foreachBatch``."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from tidemark.functions.severity import SARIF_LEVEL, lookup


def sarif(findings: DataFrame, path: str) -> None:
    """Rules (the first finding of each type) and results as JSON lines below ``path``; findings without a file go."""
    f = findings.where("file is not null and file <> ''")
    first = f.groupBy("type").agg(F.min(F.struct("file", "line", "message", "severity")).alias("m"))
    level = lambda c: lookup(c, SARIF_LEVEL, "note")
    first.select(F.col("type").alias("id"), F.struct(F.col("m.message").alias("text")).alias("shortDescription"), F.struct(level(F.col("m.severity")).alias("level")).alias("defaultConfiguration")).write.mode("overwrite").json(f"{path}/rules")
    region = F.struct(F.col("line").alias("startLine"))
    place = F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    f.select(F.col("type").alias("ruleId"), level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations")).write.mode("overwrite").json(f"{path}/results")


def newest(rows: DataFrame, keys: list[str], order: list[Column], keep: int) -> DataFrame:
    """The first ``keep`` rows of each key in ``order``: retention before an overwrite."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= keep).drop("_nth")


def verify_chain(audit: DataFrame) -> DataFrame:
    """Rows of an audit log (log, seq, body, previous_hash, entry_hash) whose link or own hash is wrong or missing."""
    w = Window.partitionBy("log").orderBy("seq")
    linked = audit.withColumn("_before", F.coalesce(F.lag("entry_hash").over(w), F.lit("")))
    own = F.sha2(F.concat("previous_hash", "body"), 256)  # null with a null of either
    right = F.col("_before").eqNullSafe(F.col("previous_hash")) & own.isNotNull() & own.eqNullSafe(F.col("entry_hash"))
    return linked.where(~right).drop("_before")


def signed(rows: DataFrame, secret: str, col: str = "body") -> DataFrame:
    """``rows`` with the HMAC-SHA256 of ``col`` in ``signature`` (Spark has no built-in for it)."""

    @F.pandas_udf("string")
    def sign(body: pd.Series) -> pd.Series:
        return body.map(lambda b: None if b is None else hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest())

    return rows.withColumn("signature", sign(F.col(col)))


def deliver(post: Callable[[str, list], bool], hook: str, most_failures: int = 5) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that posts partitions from the executors and stops a hook after repeated failures."""
    failures = 0

    def each(batch: DataFrame, epoch: int) -> None:
        nonlocal failures
        if failures >= most_failures:
            return

        def send(parts):
            for pdf in parts:
                yield pd.DataFrame({"ok": [post(hook, pdf.to_dict("records"))]})

        bad = batch.mapInPandas(send, "ok boolean").where("not ok").count()
        failures = failures + 1 if bad else 0

    return each


LEDGER = "hook string, ok boolean, sent long"


def deliver_once(post: Callable[[str, list, str], bool], hook: str, folder: str, most_failures: int = 5) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that posts partitions from the executors and keeps a ledger in the shared folder.

    ``post`` gets the hook, the rows and a key that is the same when a batch is repeated, so a receiver can tell. An
    epoch in the ledger is not sent again, whatever driver asks: what was sent is repeated at most for the epoch that a
    driver died in. A post that raises has failed. After ``most_failures`` failed epochs in a row the hook is
    off, also for the next driver; deleting its ledger turns it on.
    """
    path = f"{folder.rstrip('/')}/{hashlib.sha256(hook.encode()).hexdigest()[:16]}"

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.schema(LEDGER + ", epoch long").parquet(path).select("epoch", "ok").orderBy(F.desc("epoch")).limit(most_failures).collect()
            done = not spark.read.schema(LEDGER + ", epoch long").parquet(path).where(F.col("epoch") == epoch).isEmpty()
        except AnalysisException:
            known, done = [], False  # nothing was sent yet
        if done or len(known) == most_failures and not any(r["ok"] for r in known):
            return

        def send(parts):
            for n, pdf in enumerate(parts):
                key = f"{epoch}-{TaskContext.get().partitionId()}-{n}"
                try:
                    ok = bool(post(hook, pdf.to_dict("records"), key))
                except Exception:  # whatever a receiver does, the stream goes on
                    ok = False
                yield pd.DataFrame({"ok": [ok], "n": [len(pdf)]})

        sent = batch.mapInPandas(send, "ok boolean, n long").agg(F.min("ok").alias("ok"), F.sum(F.when(F.col("ok"), F.col("n"))).alias("n")).first()
        spark.createDataFrame([(hook, sent["ok"] is not False, sent["n"] or 0)], LEDGER).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return each
