"""Small files wherever Spark can write: a folder on this machine, or any Hadoop file system."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A file's contents; None where there is no such file."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Replace a file whole: a new one is written beside it and takes its name."""
    fs, p = _at(spark, path)
    _, new = _at(spark, f"{path}.{uuid.uuid4().hex}.new")
    stream = fs.create(new, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(new, p):
        raise OSError(f"{path} could not be replaced")
