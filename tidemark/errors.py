"""Failures of user functions: stop the job, or divert the record to the dead letters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .failures import StreamProcessingError, marked, told
from .flow import Flow

__all__ = ["Columns", "Record", "StreamProcessingError", "attempted", "called", "dead_letters", "guarded", "marked", "told"]


class Record(Mapping):
    """A row of an Arrow batch as a mapping.  Columns become Python values when a record first asks for them, a batch at a time."""

    __slots__ = ("_batch", "_at")

    def __init__(self, batch: Columns, at: int):
        self._batch, self._at = batch, at

    def __getitem__(self, name: str):
        return self._batch.values(name)[self._at]

    def __iter__(self) -> Iterator[str]:
        return iter(self._batch.names)

    def __len__(self) -> int:
        return len(self._batch.names)


class Columns:
    """The columns of a batch, read on demand."""

    def __init__(self, batch: pa.RecordBatch, names: list[str]):
        self._batch, self.names, self._read = batch, names, {}

    def values(self, name: str) -> list:
        if name not in self._read:
            if name not in self.names:
                raise KeyError(name)
            self._read[name] = self._batch.column(name).to_pylist()
        return self._read[name]

    def records(self) -> Iterator[Record]:
        return (Record(self, i) for i in range(self._batch.num_rows))


def dead_letters(df: DataFrame, stage: str, error: Column) -> DataFrame:
    """Records with the stage and the error in their headers."""
    told = F.create_map(F.lit("dlq_stage"), F.lit(stage), F.lit("dlq_error"), F.coalesce(error, F.lit("")))
    own = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("dlq_stage", "dlq_error"))
    return df.withColumn("headers", F.map_concat(own, told))


def attempted(fn: Callable, *args, retries: int) -> tuple[bool, object, str | None, int]:
    """ok, value, error, attempts."""
    error = None
    for attempt in range(1, max(1, retries + 1) + 1):
        try:
            return True, fn(*args), None, attempt
        except Exception as e:  # what the policy is about
            error = f"{type(e).__name__}: {e}"
    return False, None, error, attempt


def called(df: DataFrame, fn: Callable[[Mapping], object], result: T.DataType, *, retries: int) -> DataFrame:
    """df plus ``__call`` (ok, value, error, attempts): an opaque function on each record, a mapping, in Arrow batches.  Columns that it doesn't ask for stay in Arrow."""
    call = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("value", result), T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType())])
    schema = T.StructType([*df.schema.fields, T.StructField("__call", call)])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(call)

    def run(batches):
        for b in batches:
            found = [attempted(fn, r, retries=retries) for r in Columns(b, schema.names[:-1]).records()]
            cols = [pa.array(x, f.type) for x, f in zip(zip(*found, strict=True) if found else [()] * 4, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays(cols, fields=list(arrow))], names=schema.names)

    return df.mapInArrow(run, schema)


def guarded(flow: Flow, stage: str, calls: DataFrame, use: Callable[[DataFrame], DataFrame], on_error: str) -> Flow:
    """Results of calls that went well through ``use``; the others by policy: ``fail_job`` raises in the task, ``skip`` and ``retry`` divert.

    For ``skip`` and ``retry`` the calls are persisted, so that both sides come from one run of the function; ``Flow.release`` (a job does it) lets them go.
    """
    if on_error not in ("fail_job", "skip", "retry"):
        raise ValueError(f"unknown policy {on_error!r}")
    ok = F.col("__call.ok")
    if on_error == "fail_job":
        checked = calls.where(ok | F.raise_error(marked(stage, F.col("__call.error"))).cast("boolean"))
        return flow.with_df(use(checked))
    calls = calls.persist()
    failed = dead_letters(calls.where(~ok), stage, F.col("__call.error")).drop("__call")
    return flow.with_df(use(calls.where(ok))).emit("dlq", failed).holding(calls)
