"""Lines that are appended to a file, as a stream: a Python data source whose offset is a line and a byte."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "offset bigint, partition string, value string"


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, seek: int):
        self.path, self.seek = path, seek

    def initialOffset(self) -> dict:
        return {"line": 0, "byte": 0}

    def _rows(self, start: dict, end: int | None) -> tuple[list[tuple], dict]:
        """Whole lines from the start; a line without its line feed waits."""
        rows, line, at = [], start["line"], start["byte"]
        if os.path.exists(self.path):
            with open(self.path, "rb") as f:
                f.seek(at)
                for raw in f:
                    if not raw.endswith(b"\n") or (end is not None and at >= end):
                        break
                    text = raw.decode("utf-8", "replace").rstrip("\r\n")
                    if text.strip() and line >= self.seek:
                        rows.append((line, self.path, text))
                    line, at = line + 1, at + len(raw)
        return rows, {"line": line, "byte": at}

    def read(self, start: dict):
        rows, end = self._rows(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._rows(start, end["byte"])[0])

    def commit(self, end: dict) -> None:
        """Spark's checkpoint keeps the offsets."""


class TailDataSource(DataSource):
    """``spark.readStream.format("tidemark_tail").option("path", ...)``; the file is read on the driver."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_tail"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("seek", "0")))


def tail(spark: SparkSession, path: str, *, seek: int = 0) -> DataFrame:
    """A stream of (offset, partition, value) of a file's lines, those to come included."""
    spark.dataSource.register(TailDataSource)
    return spark.readStream.format("tidemark_tail").option("path", path).option("seek", str(seek)).load()
