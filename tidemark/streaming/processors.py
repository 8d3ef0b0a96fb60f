"""Folds on streams, with state that survives restarts.

The same folds run over bounded tables (``operators.folding``).  State is one value for each key in the RocksDB store; within a micro-batch records are
taken by offset.  What a fold keeps for the end of its input is emitted for a record of the far future (``drain``), since a stream has no end.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import event_micros
from ..functions.durations import micros
from ..operators.folding import Fold, Sample, Throttle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Held:
    """An emitted value that belongs to an earlier record than the one that the fold is at."""

    record: dict
    value: object


class FoldProcessor(StatefulProcessor):
    """Runs a fold over one key's records.  ``what`` gives the fold's input from a record."""

    def __init__(self, fold: Fold, what: Callable[[dict], object], columns: list[str]):
        self.fold, self.what, self.columns = fold, what, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", T.StructType([T.StructField("state", T.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("offset", kind="stable")
        state = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else self.fold.start()
        rows = []
        for record in batch.to_dict("records"):
            state, out = self.fold.step(state, self.what(record))
            rows += [{**(v.record if isinstance(v, Held) else record), "__value": v.value if isinstance(v, Held) else v} for v in out]
        self.state.update((pickle.dumps(state),))
        out = pd.DataFrame(rows, columns=[*self.columns, "__value"], dtype=object)
        yield out

    def close(self) -> None: ...


class TimeOf:
    """A record's time in microseconds (picklable)."""

    def __call__(self, record: dict):
        t = record["event_micros"]
        return None if pd.isna(t) else int(t)


class Itself:
    def __call__(self, record: dict):
        return record


def folded_stream(df: DataFrame, fold: Fold, what: Callable[[dict], object], value: T.DataType) -> DataFrame:
    """The stream's records with a column ``__value`` for each value that the fold emits."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = T.StructType([*df.schema.fields, T.StructField("__value", value)])
    return df.groupBy("key").transformWithStateInPandas(FoldProcessor(fold, what, df.columns), schema, outputMode="Update", timeMode="None")


def throttle_stream(df: DataFrame, interval) -> DataFrame:
    """As the operator ``throttle``."""
    out = folded_stream(df.withColumn("event_micros", event_micros()), Throttle(micros(interval)), TimeOf(), T.BooleanType())
    return out.where("__value").drop("event_micros", "__value")


class _Scan(Fold):
    def __init__(self, step: Callable, seed):
        self._step, self._seed = step, seed

    def start(self):
        return self._seed

    def step(self, state, record):
        state = self._step(state, record)
        return state, [state]


def scan_stream(df: DataFrame, step: Callable, seed, name: str, kind: T.DataType) -> DataFrame:
    """As the operator ``scan_op`` with a callable."""
    return folded_stream(df, _Scan(step, seed), Itself(), kind).withColumnRenamed("__value", name)


class _Changed(Fold):
    def __init__(self, column: str):
        self.column = column

    def step(self, state, record):
        now = (record[self.column],)
        return now, [True] if now != state else []


def distinct_stream(df: DataFrame, column: str) -> DataFrame:
    """As the operator ``distinct_until_changed``."""
    return folded_stream(df, _Changed(column), Itself(), T.BooleanType()).drop("__value")


def sample_stream(df: DataFrame, interval) -> DataFrame:
    """As the operator ``sample``, without the key's last record, which a stream doesn't know."""
    out = folded_stream(df.withColumn("event_micros", event_micros()), Sample(micros(interval)), TimeOf(), T.BooleanType())
    return out.where("__value").drop("event_micros", "__value")


class _Timeout(Fold):
    def __init__(self, gap: int):
        self.gap, self.time = gap, TimeOf()

    def step(self, before, record):
        t = self.time(record)
        return t, [before, None] if before is not None and t - before >= self.gap else [None]


def timeout_stream(df: DataFrame, interval) -> DataFrame:
    """As the operator ``timeout``: ``timeout`` marks the markers, which have ``since`` and ``at`` and the offset of the record that ended the silence."""
    out = folded_stream(df.withColumn("event_micros", event_micros()), _Timeout(micros(interval)), Itself(), T.LongType())
    return out.withColumns({"timeout": F.col("__value").isNotNull(), "since": F.timestamp_micros("__value"), "at": F.when(F.col("__value").isNotNull(), F.timestamp_micros("event_micros"))}).drop("event_micros", "__value")


class _Debounce(Fold):
    def __init__(self, gap: int):
        self.gap, self.time = gap, TimeOf()

    def step(self, held, record):
        passed = held is not None and self.time(record) - self.time(held) >= self.gap
        return record, [Held(held, True)] if passed else []


def debounce_stream(df: DataFrame, interval) -> DataFrame:
    """As the operator ``debounce`` over input in order: a record is out when its key's next one is an interval later; the last one waits for that."""
    out = folded_stream(df.withColumn("event_micros", event_micros()), _Debounce(micros(interval)), Itself(), T.BooleanType())
    return out.drop("event_micros", "__value")


class _Late(Fold):
    def __init__(self, bound: int):
        self.bound = bound

    def step(self, high, t):
        if t is None:
            return high, [False]
        high = t if high is None else max(high, t)
        return high, [t < high - self.bound]


def late_stream(df: DataFrame, bounded_out_of_orderness) -> DataFrame:
    """The stream with ``late``: whether a record is older than its key's watermark.  No watermark is declared, so Spark drops none of them."""
    out = folded_stream(df.withColumn("event_micros", event_micros()), _Late(micros(bounded_out_of_orderness)), TimeOf(), T.BooleanType())
    return out.withColumnRenamed("__value", "late").drop("event_micros")


class _Lookup(Fold):
    def step(self, row, record):
        if record["is_change"]:
            return record["change"], []
        return row, [row]


def lookup_stream(records: DataFrame, changes: DataFrame) -> DataFrame:
    """As ``join_table_state`` with ``left``: each record with ``right``, its key's row when it came (null if none).  Within a micro-batch offsets decide."""
    payload = [c for c in changes.columns if c not in ("offset", "partition", "key", "event_time", "ingest_time", "headers")]
    gone = reduce(lambda a, b: a & b, (F.col(c).isNull() for c in payload))
    # rows travel as JSON: pandas would turn whole numbers into floats beside nulls
    log = changes.select("key", "offset", F.lit(True).alias("is_change"), F.when(~gone, F.to_json(F.struct(*payload))).alias("change"))
    both = log.unionByName(records.withColumn("is_change", F.lit(False)), allowMissingColumns=True)
    kind = T.StructType([changes.schema[c] for c in payload]).simpleString()
    out = folded_stream(both, _Lookup(), Itself(), T.StringType())
    return out.select(*records.columns, F.from_json("__value", kind).alias("right"))


def windows_stream(df: DataFrame, size: str, aggregates: dict, *, delay: str, slide: str | None = None) -> DataFrame:
    """Panes of a stream by Spark's own watermark: it moves with each micro-batch, and rows go by their pane's end rather than by their own time.

    Over input in order the panes are those of the bounded operators.  The last panes come when the watermark passes them.
    """
    window = F.window("event_time", size, slide) if slide else F.window("event_time", size)
    panes = df.withWatermark("event_time", delay).groupBy("key", window.alias("w")).agg(*(c.alias(k) for k, c in aggregates.items()))
    return panes.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), *aggregates)


def join_stream(left: DataFrame, right: DataFrame, window: str, *, delay: str) -> DataFrame:
    """Pairs of one key at most a window apart, each side's state bounded by its watermark."""
    span = f"{micros(window)} microseconds"
    a = left.withWatermark("event_time", delay).alias("l")
    b = right.withWatermark("event_time", delay).alias("r")
    on = F.expr(f"l.key <=> r.key AND r.event_time >= l.event_time - INTERVAL '{span}' AND r.event_time <= l.event_time + INTERVAL '{span}'")
    return a.join(b, on)
