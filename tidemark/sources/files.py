"""Files of lines as bounded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..schema import as_envelope


def read_lines(spark: SparkSession, path: str, *, schema: str | T.StructType | None = None, seek: int = 0, encoding: str = "utf-8") -> DataFrame:
    """One record for each line that isn't blank, with the line's index as offset and the file as partition.

    Blank lines take an index.  ``value`` is the raw line; with a schema, ``payload`` is the line parsed as JSON, null where it isn't.
    Indices come from counts of the blocks that Spark reads a file in, so a large file is read in parallel.
    """
    lines = spark.read.option("encoding", encoding).text(path).select("value", F.col("_metadata.file_path").alias("partition"), F.col("_metadata.file_block_start").alias("__block"))
    lines = lines.withColumn("__id", F.monotonically_increasing_id())
    blocks = lines.groupBy("partition", "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("partition").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("partition", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy("partition", "__block").orderBy("__id")) - 1
    rows = lines.withColumn("__local", local).join(blocks, ["partition", "__block"])
    rows = rows.select((F.col("__before") + F.col("__local")).cast("long").alias("offset"), "partition", "value").where((F.trim("value") != "") & (F.col("offset") >= seek))
    return as_envelope(rows if schema is None else rows.withColumn("payload", parsed(F.col("value"), schema)))


def parsed(value, schema: str | T.StructType):
    """JSON text by a schema; null where the text isn't a JSON object."""
    kind = schema if isinstance(schema, str) else schema.simpleString()
    kind = kind if kind.startswith("struct<") else T._parse_datatype_string(kind).simpleString()
    return F.when(F.try_parse_json(value).isNotNull() & F.ltrim(value).startswith("{"), F.from_json(value, kind))
