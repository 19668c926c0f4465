"""Severity order and weights. Rank 0 is the worst; never order by the name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NAMES = ("critical", "high", "medium", "low", "info")
WEIGHTS = {"critical": 10.0, "high": 7.0, "medium": 4.0, "low": 1.5, "info": 0.0}
GATE_BONUS = {"critical": 0.2, "high": 0.1, "medium": 0.0, "low": 0.0, "info": -0.1}
WATCH_POINTS = {"brute_force": 40, "injection_probe": 30, "scanner_sweep": 20, "rate_spike": 10, "error_spike": 5, "ml_outlier": 15}
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def lookup(col: Column, values: dict, default: object) -> Column:
    """``values[col]`` as a CASE expression."""
    out = None
    for key, value in values.items():
        out = F.when(col == key, F.lit(value)) if out is None else out.when(col == key, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def rank(severity: Column) -> Column:
    return lookup(severity, {n: i for i, n in enumerate(NAMES)}, len(NAMES))


def composite(severity: Column, confirmations: Column) -> Column:
    """0 to 100: ten times the severity's weight, and up to 15 for confirmations."""
    return F.least(F.lit(100.0), lookup(severity, WEIGHTS, 0.0) * 10 + F.least(confirmations * 3.0, F.lit(15.0)))


def sql_case(col: str, values: dict, default: object) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    return f"(case {col} " + " ".join(f"when '{k}' then {show(v)}" for k, v in values.items()) + f" else {show(default)} end)"


RANK_SQL = "(case {0} when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 when 'info' then 4 else 5 end)"
