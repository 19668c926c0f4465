"""Outliers of access logs by a forest of isolation trees.

Random splits separate an unusual row from the others early, so a short mean path through the trees means an
outlier. A forest is grown from a bounded sample on the driver and travels as a literal inside a column expression:
scoring needs no Python worker, no join and no shuffle. ``streaming.learned`` refits it while a stream runs.

Defined cases: a null status counts as 0, a null path or method as empty. A sample without rows gives a forest
that calls nothing an outlier; rows of a sample that are all alike have the same score and none is below the cut.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.windows import log
from tidemark.plans.staging import stage

#: What a row is judged by, in this order.
FEATURES = ("status", "path_length", "slashes", "is_post", "is_server_error", "is_missing", "query_length")
TREES, ROWS_A_TREE, SEED, SHARE = 50, 256, 42, 0.05
#: Rows a forest is grown from at most, and at least.
FIT, LEAST = 1000, 100
NODE = "array<array<struct<f:int,t:double,l:int,r:int,d:double>>>"


class Forest(NamedTuple):
    """Trees as lists of nodes (feature or -1, threshold, left, right, path length at a leaf); the score of a row
    that stands alone; the score below which the ``SHARE`` most unusual rows of the sample lie."""

    trees: list
    unit: float
    offset: float

    def dumps(self) -> str:
        return json.dumps(self._asdict())

    @staticmethod
    def loads(text: str) -> Forest:
        return Forest(**json.loads(text))


def features(status: str = "status", path: str = "path", method: str = "method") -> Column:
    s, p = F.coalesce(F.col(status), F.lit(0)), F.coalesce(F.col(path), F.lit(""))
    asked = F.coalesce(F.get(F.split(p, r"\?"), 1), F.lit(""))
    slashes = F.char_length(p) - F.char_length(F.replace(p, F.lit("/"), F.lit("")))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return F.array(s.cast("double"), F.char_length(p).cast("double"), slashes.cast("double"), flag(F.col(method) == "POST"), flag(s >= 500), flag(s == 404), F.char_length(asked).cast("double"))


def alone(n: int) -> float:
    """Mean path length that tells one of n rows apart by chance."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def _grow(rows: np.ndarray, draw: np.random.Generator, deepest: int) -> list:
    nodes: list = [None]
    todo = [(0, rows, 0)]
    while todo:
        at, own, depth = todo.pop()
        low, high = own.min(axis=0), own.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth == deepest or not len(varied):
            nodes[at] = (-1, 0.0, 0, 0, depth + alone(len(own)))
            continue
        f = int(varied[draw.integers(len(varied))])
        t = float(draw.uniform(low[f], high[f]))
        t = t if t > low[f] else float(high[f])
        left = own[:, f] < t
        nodes[at] = (f, t, len(nodes), len(nodes) + 1, 0.0)
        nodes += [None, None]
        todo += [(len(nodes) - 2, own[left], depth + 1), (len(nodes) - 1, own[~left], depth + 1)]
    return nodes


def grow(sample: np.ndarray, trees: int = TREES, seed: int = SEED, share: float = SHARE) -> Forest:
    """A forest over the sample's rows; the same rows in the same order and the same seed give the same forest."""
    if not len(sample):
        return Forest([[(-1, 0.0, 0, 0, 1.0)]], 1.0, -2.0)
    draw = np.random.Generator(np.random.PCG64(seed))
    n = min(ROWS_A_TREE, len(sample))
    deepest = int(np.ceil(np.log2(max(n, 2))))
    grown = [_grow(sample[draw.choice(len(sample), n, replace=False)], draw, deepest) for _ in range(trees)]
    forest = Forest(grown, alone(n) or 1.0, 0.0)
    return forest._replace(offset=float(np.percentile(samples_scores(forest, sample), 100 * share)))


def samples_scores(forest: Forest, rows: np.ndarray) -> np.ndarray:
    """Minus the anomaly (between 0 and 1) of each row, all trees walked for all rows at once."""
    paths = np.zeros(len(rows))
    for tree in forest.trees:
        f, t, left, right, d = (np.array(x) for x in zip(*tree, strict=True))
        at = np.zeros(len(rows), dtype=int)
        while (inner := f[at] >= 0).any():
            go = np.where(rows[np.arange(len(rows)), np.maximum(f[at], 0)] < t[at], left[at], right[at])
            at = np.where(inner, go, at)
        paths += d[at]
    return -(2.0 ** (-paths / len(forest.trees) / forest.unit))


def decision(forest: Forest, x: Column) -> Column:
    """Above 0: usual; below: among the most unusual. ``x``: the features as an array."""
    most = max(len(t) for t in forest.trees).bit_length() + 2
    depth = max(most, int(np.ceil(np.log2(ROWS_A_TREE))) + 1)
    nodes = [[{"f": f, "t": t, "l": lo, "r": hi, "d": d} for f, t, lo, hi, d in tree] for tree in forest.trees]
    trees = F.from_json(F.lit(json.dumps(nodes)), NODE)  # a constant, folded once

    def path(tree: Column) -> Column:
        def down(at: Column, _: Column) -> Column:
            node = F.get(tree, at)
            return F.when(node["f"] < 0, at).when(F.get(x, node["f"]) < node["t"], node["l"]).otherwise(node["r"])

        return F.get(tree, F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down))["d"]

    total = F.aggregate(F.transform(trees, path), F.lit(0.0), lambda a, b: a + b)
    return -F.pow(F.lit(2.0), -total / len(forest.trees) / forest.unit) - F.lit(forest.offset)


def last_rows(rows: DataFrame, order: list[str], most: int = FIT) -> np.ndarray:
    """Features of the newest rows, oldest first; at most ``most``, so the driver can hold them."""
    newest = rows.select(*order, features().alias("x")).orderBy(*(F.desc(c) for c in order)).limit(most).collect()
    return np.array([r["x"] for r in reversed(newest)], dtype=float).reshape(len(newest), len(FEATURES))


def outliers(rows: DataFrame, forest: Forest, cut: float = 0.0) -> DataFrame:
    """``rows`` (status, path, method) whose decision is below ``cut``, with ``score`` (in place of one they have).

    Rows that look alike are scored once: features of a log repeat, so scoring meets few distinct rows.
    """
    seen = rows.drop("score").withColumn("_x", features())
    scored = seen.select("_x").distinct().withColumn("score", F.round(decision(forest, F.col("_x")), 9))
    # Written, or the planner would infer the same walk through all trees as a filter over every row.
    return seen.join(stage(scored, "scores").where(F.col("score") < cut), "_x").drop("_x")


def learned_outliers(spark, sf_dir):
    """All events judged by a forest grown from the last thousand."""
    rows = log(spark, sf_dir)
    forest = grow(last_rows(rows, ["us", "event_id"]))
    return outliers(rows, forest).select("event_id", "ip", "path", "status", "score")


QUERIES = {"learned_outliers": (learned_outliers, None)}
