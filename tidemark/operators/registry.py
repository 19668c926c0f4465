"""All registered queries of the core library, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import chains, cycles, findings, graph, ignores, joins, lifecycle, logs, outliers, reports, rollups, rules, secrets, telemetry, windows


def modules() -> list:
    return [findings, secrets, lifecycle, ignores, chains, windows, rollups, graph, joins, rules, logs, reports, telemetry, outliers, cycles]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in modules() for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in modules() for name, (_, sql) in m.QUERIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.routing_rollup(spark, sf_dir)
