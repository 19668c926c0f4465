"""Learned outliers over a stream: a forest that is grown anew while the stream runs.

A micro-batch is scored by the forest as it was before the batch. What the next batch needs (the newest rows, the
counts, the forest) is one bounded row an epoch, written to the shared folder before the epoch ends: a
restarted query repeats an epoch from the same state and gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.operators.outliers import FEATURES, FIT, LEAST, Forest, features, grow, outliers

STATE = "seen long, since long, forest string, newest array<struct<at:long,id:long,x:array<double>>>"
#: Rows after which a forest is grown anew, at the end of the batch that reaches them.
EVERY = 500


def _before(spark, folder: str, epoch: int):
    try:
        rows = spark.read.schema(STATE + ", epoch long").parquet(folder).where(F.col("epoch") < epoch)
    except AnalysisException:
        return None  # nothing was written yet
    return rows.orderBy(F.desc("epoch")).limit(1).collect()


def learned(stream: DataFrame, sink: Callable[[DataFrame, int], None], folder: str, checkpoint: str, *, order: tuple[str, str] = ("us", "event_id"), every: int = EVERY, fit: int = FIT, least: int = LEAST, cut: float = -0.2):
    """A writer that hands the outliers of each batch to ``sink``. ``stream``: status, path, method and ``order``."""

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        held = _before(spark, folder, epoch)
        seen, since, forest, newest = tuple(held[0])[:4] if held else (0, 0, None, [])
        batch = batch.persist()
        try:
            if forest is not None:
                sink(outliers(batch, Forest.loads(forest), cut), epoch)
            n = batch.count()
            at, id_ = order
            rows = batch.select(F.col(at).cast("long").alias("at"), F.col(id_).cast("long").alias("id"), features().alias("x")).orderBy(F.desc("at"), F.desc("id")).limit(fit).collect()
        finally:
            batch.unpersist()
        newest = sorted([tuple(r) for r in newest] + [tuple(r) for r in rows], key=lambda r: r[:2])[-fit:]
        seen, since = seen + n, since + n
        if seen >= least and (forest is None or since >= every):
            forest, since = grow(np.array([r[2] for r in newest], dtype=float).reshape(-1, len(FEATURES))).dumps(), 0
        spark.createDataFrame([(seen, since, forest, newest)], STATE).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
