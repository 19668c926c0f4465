"""Bounded samples that do not depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest_hashes(rows: DataFrame, column: str, most: int) -> DataFrame:
    """The ``most`` rows with the smallest hashes of ``column``; all rows if there are no more.

    A first cut by hash leaves about twice as many as are wanted, so the final ordering sees a number of
    rows that depends neither on the input nor on its partitions.
    """
    total = rows.count()
    if total <= most:
        return rows
    h = F.xxhash64(column)
    bound = min(-(1 << 63) + int(2 * most / total * (1 << 64)), (1 << 63) - 1)
    return rows.where(h <= F.lit(bound)).orderBy(h, column).limit(most)
