"""Ordered folds over groups of any size: rows pass by sorted, and only one group's state is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.plans.shipping import ship


def fold_groups(rows: DataFrame, keys: list[str], order: list[str], values: list[str], start: Callable[[], object], step: Callable, finish: Callable[[object], list[tuple]], schema: str) -> DataFrame:
    """``finish(state)`` rows (after the keys) of each group, ``state = step(state, *values)`` over its ordered rows.

    A group is read by one task but never gathered: a key with a third of all rows costs time, not memory.
    ``schema``: the columns after the keys.
    """
    ship(rows.sparkSession)
    wanted = rows.select(*keys, *dict.fromkeys(c for c in (*order, *values) if c not in keys))
    whole = StructType([*wanted.select(*keys).schema.fields, *StructType.fromDDL(schema).fields])
    names, width, added = whole.names, len(keys), list(to_arrow_schema(StructType.fromDDL(schema)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state, out = None, None, []

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=kinds)
            out.clear()
            return batch

        kinds = None
        for batch in batches:
            if kinds is None:
                kinds = pa.schema([*(batch.schema.field(k) for k in keys), *added])
            for row in zip(*(batch.column(c).to_pylist() for c in (*keys, *values)), strict=True):
                if row[:width] != group:
                    if group is not None:
                        out.extend((*group, *r) for r in finish(state))
                    group, state = row[:width], start()
                state = step(state, *row[width:])
            if len(out) > 1000:
                yield made()
        if group is not None:
            out.extend((*group, *r) for r in finish(state))
            yield made()

    return wanted.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, whole)

