"""Folds that window functions can't express, written once for bounded tables and for streams.

A fold has a state for each key and looks at the key's records one by one in arrival order.  Over a bounded table, rows are dealt by key and
sorted within partitions; a task streams over them with one state at a time, so a key's size doesn't matter to memory.
"""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..errors import Columns


class Fold:
    def start(self) -> Any:
        """The state before the first record."""
        return None

    def step(self, state: Any, record: Any) -> tuple[Any, list]:
        """The state after a record, and the values to emit for it."""
        raise NotImplementedError

    def finish(self, state: Any) -> list:
        """Values to emit when no record follows."""
        return []


class Throttle(Fold):
    """Passes a record when none passed yet, or the last that did is at least a gap older."""

    def __init__(self, gap: int):
        self.gap = gap

    def step(self, last, t):
        if t is not None and (last is None or t - last >= self.gap):
            return t, [True]
        return last, [False]


class Sample(Fold):
    """The first record sets the tick; a record at or after the tick passes and sets the next one a gap later."""

    def __init__(self, gap: int):
        self.gap = gap

    def step(self, tick, t):
        if t is None:
            return tick, [False]
        if tick is None:
            return t + self.gap, [False]
        if t >= tick:
            return t + self.gap, [True]
        return tick, [False]


def chosen(df: DataFrame, fold: Fold, time: str) -> DataFrame:
    """The rows that a fold over a time column (in microseconds) passes.  Payloads ride along in Arrow and never become Python objects."""
    rows = df.withColumn("__hash", F.xxhash64("key"))

    def run(batches):
        key, state = None, None
        for b in batches:
            hashes, keys, times = b.column("__hash").to_pylist(), b.column("key").to_pylist(), b.column(time).to_pylist()
            mask = []
            for h, k, t in zip(hashes, keys, times, strict=True):
                if (h, k) != key:
                    key, state = (h, k), fold.start()
                state, out = fold.step(state, t)
                mask.append(bool(out and out[0]))
            yield b.filter(pa.array(mask, pa.bool_()))

    return rows.repartition("key").sortWithinPartitions("__hash", "key", "offset").mapInArrow(run, rows.schema).drop("__hash")


def folded(df: DataFrame, fold: Fold, result: T.StructType) -> DataFrame:
    """One row for each value that the fold emits: the columns of its record, with those of ``result``.  The fold asks the record for what it needs; the rest stays in Arrow."""
    rows = df.withColumn("__hash", F.xxhash64("key"))
    new = [f for f in result.fields]
    schema = T.StructType([*(f for f in df.schema.fields if f.name not in result.names), *new])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds, names = [to_arrow_type(f.dataType) for f in new], df.columns

    def run(batches):
        key, state = None, None
        for b in batches:
            at, values = [], []
            columns = Columns(b, names)
            hashes, keys = b.column("__hash").to_pylist(), columns.values("key")
            for i, record in enumerate(columns.records()):
                if (hashes[i], keys[i]) != key:
                    key, state = (hashes[i], keys[i]), fold.start()
                state, out = fold.step(state, record)
                at += [i] * len(out)
                values += out
            kept = b.select([f.name for f in schema.fields if f.name not in result.names]).take(pa.array(at, pa.int64()))
            cols = [pa.array([v[n] if len(new) > 1 else v for v in values], kind) for n, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *cols], names=schema.names)

    return rows.repartition("key").sortWithinPartitions("__hash", "key", "offset").mapInArrow(run, schema)
