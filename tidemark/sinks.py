"""Where records go.  A sink has ``write(df)``, ``flush()`` and ``close()``; those for single records stream over the rows on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime, timedelta
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from .errors import dead_letters
from .failures import StreamProcessingError
from .functions.clock import Clock, WallClock
from .functions.durations import parse_duration
from .schema import ENGINE


@runtime_checkable
class Sink(Protocol):
    def write(self, df: DataFrame) -> None: ...
    def flush(self) -> None: ...
    def close(self) -> None: ...


class RowSink:
    """For effects that only the driver can have: one row after the other, by arrival, never all at once."""

    def write(self, df: DataFrame) -> None:
        rows = df.orderBy("offset") if "offset" in df.columns else df
        for row in rows.toLocalIterator(prefetchPartitions=True):
            self.write_row(row)

    def write_row(self, row: Row) -> None:
        raise NotImplementedError

    def flush(self) -> None: ...
    def close(self) -> None: ...


class CallbackSink(RowSink):
    def __init__(self, fn: Callable[[Row], object]):
        self.write_row = fn


class MemorySink(RowSink):
    def __init__(self):
        self.items: list[Row] = []

    def write_row(self, row: Row) -> None:
        self.items.append(row)

    @property
    def payloads(self) -> list[dict]:
        """The rows' own columns."""
        return [{k: v for k, v in r.asDict(recursive=True).items() if k not in ENGINE} for r in self.items]


class StdoutSink(RowSink):
    def write_row(self, row: Row) -> None:
        print(row.asDict(recursive=True), flush=True)


class FileSink:
    """JSON lines, appended to a folder by the executors."""

    def __init__(self, path: str):
        self.path = path

    def write(self, df: DataFrame) -> None:
        df.write.mode("append").json(self.path)

    def flush(self) -> None: ...
    def close(self) -> None: ...


class TableSink:
    """Parquet, appended to a folder by the executors."""

    def __init__(self, path: str):
        self.path = path

    def write(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)

    def flush(self) -> None: ...
    def close(self) -> None: ...


class CircuitBreaker:
    """Closed until so many failures in a row, then open; half open after a while, when one success closes it and one failure opens it again."""

    def __init__(self, failure_threshold: int = 5, reset_after: str | float | timedelta = "30s", clock: Clock | None = None):
        self.failure_threshold, self.reset_after, self.clock = failure_threshold, parse_duration(reset_after), clock or WallClock()
        self._failures, self._opened, self._half = 0, None, False

    @property
    def state(self) -> str:
        if self._opened is None:
            return "closed"
        if self._half or self._now() - self._opened >= self.reset_after:
            self._half = True
            return "half_open"
        return "open"

    def _now(self) -> datetime:
        return self.clock.now()

    def allows(self) -> bool:
        return self.state != "open"

    def success(self) -> None:
        self._failures, self._opened, self._half = 0, None, False

    def failure(self) -> None:
        self._failures += 1
        if self.state == "half_open" or self._failures >= self.failure_threshold:
            self._opened, self._half = self._now(), False


class ProtectedSink:
    """Tries each record (for sinks that write tables, each table) ``retries`` + 1 times.  One that fails every time counts once against the breaker and goes to ``dead``, as
    does what comes while the breaker is open; the job goes on.

    ``dead`` is a sink (it gets dead letters: records with stage and error in their headers) or a function of (row, stage, error).  Nothing is lost in silence: without
    ``dead``, ``flush`` raises if records failed.
    """

    BUFFER = 1000

    def __init__(self, inner: Sink, *, retries: int = 2, breaker: CircuitBreaker | None = None, dead: Sink | Callable[[Row, str, str], object] | None = None):
        self.inner, self.retries, self.breaker, self.dead = inner, retries, breaker or CircuitBreaker(), dead
        self.failed, self._last = 0, ""

    def _attempt(self, write: Callable, what) -> str | None:
        """The error that is left after all attempts."""
        if not self.breaker.allows():
            return "circuit_open"
        error = None
        for _ in range(self.retries + 1):
            try:
                write(what)
            except Exception as e:  # a sink may fail in any way
                error = f"{type(e).__name__}: {e}"
            else:
                self.breaker.success()
                return None
        self.breaker.failure()
        return error

    def write(self, df: DataFrame) -> None:
        if getattr(type(self.inner), "write", None) is not RowSink.write:
            error = self._attempt(self.inner.write, df)
            if error is not None:
                self._bury(df, F.lit(error), error)
            return
        rows, held = (df.orderBy("offset") if "offset" in df.columns else df), []
        for row in rows.toLocalIterator(prefetchPartitions=True):
            error = self._attempt(self.inner.write_row, row)
            if error is None:
                continue
            held.append((row, error))
            if len(held) >= self.BUFFER:
                self._bury_rows(df, held)
                held = []
        if held:
            self._bury_rows(df, held)

    def _bury_rows(self, df: DataFrame, held: list[tuple[Row, str]]) -> None:
        if self.dead is None or not hasattr(self.dead, "write"):
            for row, error in held:
                self._bury_row(row, error)
            return
        schema = T.StructType([*df.schema.fields, T.StructField("__error", T.StringType())])
        rows = df.sparkSession.createDataFrame([(*row, error) for row, error in held], schema)
        self._bury(rows, F.col("__error"), held[-1][1], n=len(held))

    def _bury_row(self, row: Row, error: str) -> None:
        self.failed, self._last = self.failed + 1, error
        if self.dead is not None:
            self.dead(row, "sink", error)

    def _bury(self, df: DataFrame, error: Column, last: str, n: int | None = None) -> None:
        if self.dead is not None and not hasattr(self.dead, "write"):
            for row in df.toLocalIterator():
                self._bury_row(row, last)
            return
        self.failed, self._last = self.failed + (df.count() if n is None else n), last
        if self.dead is not None:
            full = df if "headers" in df.columns else df.withColumn("headers", F.create_map().cast("map<string,string>"))
            self.dead.write(dead_letters(full, "sink", error).drop("__error"))

    def flush(self) -> None:
        self.inner.flush()
        if self.failed and self.dead is None:
            failed, self.failed = self.failed, 0
            raise StreamProcessingError("sink", f"{failed} records failed and there are no dead letters; the last: {self._last}")

    def close(self) -> None:
        self.inner.close()


def close_all(sinks: Iterable[Sink]) -> None:
    for s in sinks:
        s.close()
