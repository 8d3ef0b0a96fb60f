"""What a source is, and flows that remember theirs."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession

from ..flow import Flow
from .files import read_lines


@runtime_checkable
class Source(Protocol):
    """``read`` gives what there is from the positions on, as records; positions are by partition."""

    def read(self, spark: SparkSession, schema=None) -> DataFrame: ...
    def seek(self, partition, offset: int) -> None: ...
    def commit(self, partition, offset: int) -> None: ...
    def committed(self, partition) -> int: ...
    def close(self) -> None: ...


class FileSource:
    """The lines of files, from an index on (for every file alike); commits are kept by the object."""

    def __init__(self, path: str, *, encoding: str = "utf-8"):
        self.path, self.encoding, self.position, self._done = path, encoding, 0, {}

    def read(self, spark: SparkSession, schema=None) -> DataFrame:
        return read_lines(spark, self.path, schema=schema, seek=self.position, encoding=self.encoding)

    def seek(self, partition, offset: int) -> None:
        self.position = offset

    def commit(self, partition, offset: int) -> None:
        self._done[partition] = offset

    def committed(self, partition) -> int:
        return self._done.get(partition, self.position)

    def close(self) -> None:
        """Nothing is held open."""


def from_source(spark: SparkSession, source: Source, schema=None) -> Flow:
    """The records of any source, as a flow that a job can seek, commit and close."""
    return Flow(source.read(spark, schema), source=source)
