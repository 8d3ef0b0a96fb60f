"""A bounded buffer that threads push into and Spark drains."""

from __future__ import annotations

import json
import threading
import time
from collections import deque

from pyspark.sql import DataFrame, SparkSession, types as T

from ..schema import as_envelope
from .files import parsed

ROW = T.StructType([T.StructField("offset", T.LongType()), T.StructField("partition", T.StringType()), T.StructField("value", T.StringType())])


class FullQueue(Exception):
    """No room came in time."""


class QueueSource:
    """Policies for a full buffer: ``block`` waits, ``drop_oldest`` evicts the head, ``sample`` rejects the new one.  Rejected records take an offset too.

    What was drained can't be read again, so restarts deliver at most once.
    """

    def __init__(self, maxsize: int = 256, policy: str = "block"):
        if policy not in ("block", "drop_oldest", "sample"):
            raise ValueError(f"unknown policy {policy!r}")
        self.maxsize, self.policy = maxsize, policy
        self._held: deque[tuple[int, str, str]] = deque()
        self._room = threading.Condition()
        self._next, self._closed = 0, False

    def push(self, payload, *, timeout: float | None = None) -> bool:
        """Whether the record was taken."""
        with self._room:
            if self._closed:
                return False
            offset, self._next = self._next, self._next + 1
            if len(self._held) >= self.maxsize:
                if self.policy == "sample":
                    return False
                if self.policy == "drop_oldest":
                    self._held.popleft()
                elif not self._room.wait_for(lambda: len(self._held) < self.maxsize or self._closed, timeout):
                    raise FullQueue(f"{self.maxsize} records wait")
            if self._closed:
                return False
            self._held.append((offset, "q", json.dumps(payload)))
            self._room.notify_all()
            return True

    def drain(self, spark: SparkSession, *, schema: str | T.StructType | None = None, wait: float = 0.0) -> DataFrame:
        """What waits, at most ``maxsize`` records, as a table; ``value`` is JSON, and with a schema ``payload`` its fields."""
        end = time.monotonic() + wait
        with self._room:
            while not self._held and not self._closed and (left := end - time.monotonic()) > 0:
                self._room.wait(left)
            rows = list(self._held)
            self._held.clear()
            self._room.notify_all()
        df = as_envelope(spark.createDataFrame(rows, ROW))
        return df if schema is None else df.withColumn("payload", parsed(df["value"], schema))

    def close(self) -> None:
        """No more pushes; what waits can still be drained."""
        with self._room:
            self._closed = True
            self._room.notify_all()
