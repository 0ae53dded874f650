"""Folds of ordered rows in constant memory: one state a key, carried from row to row while a sorted partition streams by."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 4096


def spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows shuffled by key. Where there are no more keys than partitions each key has one to itself, as two long keys that a hash puts
    together would take twice the time; otherwise there are four times as many partitions, so that what hashes together is small."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.select(*keys).distinct().limit(n + 1).collect()
    if not found or len(found) > n:
        return rows.repartition(4 * n, *keys)
    kinds = [rows.schema[k].dataType for k in keys]
    known = F.array(*[F.struct(*[F.lit(v).cast(kind).alias(k) for k, v, kind in zip(keys, row, kinds, strict=True)]) for row in found])
    return rows.repartitionById(n, F.array_position(known, F.struct(*keys)).cast("int") - 1)


def fold_sorted(rows: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, schema: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """What ``step(state, row)`` returns, a list of dicts, for every row of every key in order; ``start(row)`` gives a key its state.

    Rows are shuffled by key and sorted by Spark, which spills; a task holds one state and a batch of rows, so a key of any
    number of rows takes no more memory than its state. ``schema`` names the columns of the result with their Spark and Arrow types.
    """
    arrow = pa.schema([(name, kind) for name, (_, kind) in schema.items()])

    def apply(batches):
        key, state, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != key:
                    key, state = own, start(row)
                out += step(state, row)
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return spread(rows, keys).sortWithinPartitions(*keys, *order).mapInArrow(apply, ", ".join(f"{name} {kind}" for name, (kind, _) in schema.items()))
