"""A partitioned, append-only log in a folder: one file of JSON lines for each partition, offsets by line."""

from __future__ import annotations

import json
import os
import threading
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import as_envelope
from .tail import tail

LINE = "offset bigint, partition string, key string, event_time string, headers map<string,string>, payload string"


class PartitionedLog:
    """The partition of a record is said by who appends it, not taken from its key."""

    def __init__(self, path: str, partitions: int = 1):
        self.path, self.partitions = Path(path), partitions
        self.path.mkdir(parents=True, exist_ok=True)
        self._lock = threading.Lock()
        self._next = []
        for p in range(partitions):
            self.file(p).touch()
            with self.file(p).open("rb") as f:
                self._next.append(sum(1 for _ in f))

    def file(self, partition: int) -> Path:
        return self.path / f"partition-{partition:05d}.jsonl"

    def append(self, payload, *, key: str | None = None, event_time: datetime | None = None, partition: int = 0, headers: dict | None = None) -> int:
        """Add a record; returns its offset in the partition."""
        if not 0 <= partition < self.partitions:
            raise IndexError(f"no partition {partition}")
        with self._lock:
            offset = self._next[partition]
            when = event_time.astimezone(timezone.utc).isoformat() if event_time else None
            record = {"offset": offset, "partition": str(partition), "key": key, "event_time": when, "headers": headers or {}, "payload": json.dumps(payload)}
            with self.file(partition).open("a", encoding="utf-8") as f:
                f.write(json.dumps(record) + "\n")
            self._next[partition] += 1
            return offset

    def consumer(self, start_offsets: dict[int, int] | None = None) -> LogConsumer:
        return LogConsumer(self, start_offsets or {})


class LogConsumer:
    """Reads from its positions on; what it has committed is kept in the log's folder and found again."""

    def __init__(self, log: PartitionedLog, start: dict[int, int]):
        self.log = log
        self._file = log.path / "committed.json"
        held = {int(k): v for k, v in json.loads(self._file.read_text()).items()} if self._file.exists() and not start else {}
        self.position = {p: start.get(p, held.get(p, -1) + 1) for p in range(log.partitions)}
        self._start, self._done = dict(self.position), held

    def seek(self, partition: int, offset: int) -> None:
        self.position[partition] = offset

    def commit(self, partition: int, offset: int) -> None:
        """Say that a record, and all before it in its partition, are done."""
        self._done[partition] = offset
        self.position[partition] = offset + 1
        temporary = self._file.with_suffix(".tmp")
        temporary.write_text(json.dumps(self._done))
        os.replace(temporary, self._file)

    def committed(self, partition: int) -> int:
        """The last committed offset; the start position before any commit."""
        return self._done.get(partition, self._start[partition])

    def _records(self, lines: DataFrame, schema: str | T.StructType | None) -> DataFrame:
        r = lines.select(F.from_json("value", LINE).alias("r")).select("r.*")
        r = r.withColumn("event_time", F.to_timestamp("event_time"))
        if schema is not None:
            kind = schema if isinstance(schema, str) else schema.simpleString()
            r = r.withColumn("payload", F.from_json("payload", kind)).select(*(c for c in r.columns if c != "payload"), "payload.*")
        return r

    def read(self, spark: SparkSession, schema: str | T.StructType | None = None) -> DataFrame:
        """What is in the log from the positions on.  Arrival is partition by partition: ``arrival`` orders it, ``offset`` is that in the partition."""
        lines = spark.read.text([str(self.log.file(p)) for p in range(self.log.partitions)])
        records = self._records(lines, schema)
        after = None
        for p, at in self.position.items():
            part = (F.col("partition") == str(p)) & (F.col("offset") >= at)
            after = part if after is None else after | part
        arrival = F.struct(F.col("partition").cast("int").alias("partition"), F.col("offset"))
        return as_envelope(records.where(after)).withColumn("arrival", arrival)

    def stream(self, spark: SparkSession, schema: str | T.StructType | None = None) -> DataFrame:
        """The same, and what will be appended."""
        parts = [self._records(tail(spark, str(self.log.file(p)), seek=at), schema) for p, at in self.position.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def close(self) -> None:
        """Nothing is held open."""
