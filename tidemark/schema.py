"""The envelope: engine columns that every record carries beside its own columns."""

from __future__ import annotations

from collections.abc import Iterable, Sized

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: offset orders arrival; partition names the source's part; key is null until set.
ENVELOPE = T.StructType([
    T.StructField("offset", T.LongType()),
    T.StructField("partition", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("ingest_time", T.TimestampType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
])
ENGINE = [f.name for f in ENVELOPE]


def as_envelope(df: DataFrame, **columns: Column | str) -> DataFrame:
    """df with the engine columns that it lacks; ``columns`` names expressions for some of them."""
    given = {k: F.expr(v) if isinstance(v, str) else v for k, v in columns.items()}
    out = df
    for f in ENVELOPE:
        if f.name in given:
            out = out.withColumn(f.name, given[f.name].cast(f.dataType) if f.name != "key" else given[f.name])
        elif f.name not in df.columns:
            empty = F.create_map().cast(f.dataType) if f.name == "headers" else F.lit(None).cast(f.dataType)
            out = out.withColumn(f.name, empty)
    return out.select(*ENGINE, *(c for c in out.columns if c not in ENGINE))


def from_iterable(spark: SparkSession, rows: Iterable, schema: str | T.StructType, **columns: Column | str) -> DataFrame:
    """Records from a sized collection, in its order (offsets 0, 1, ...); anything without a length is refused, as it could be read only once."""
    if not isinstance(rows, Sized):
        raise TypeError("from_iterable needs a collection with a length")
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if "offset" in schema.names:
        return as_envelope(spark.createDataFrame(list(rows), schema), **columns)
    numbered = T.StructType([T.StructField("offset", T.LongType()), *schema.fields])
    tuples = [(i, *(r if isinstance(r, (tuple, list)) else (r,))) for i, r in enumerate(rows)]
    return as_envelope(spark.createDataFrame(tuples, numbered), **columns)


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as records: arrival by event_id, keyed by user, amounts also in whole cents."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return as_envelope(
        e.select("event_id", "user_id", "event_type", "value", "props", F.col("ts").cast("timestamp").alias("event_time")).withColumn("cents", F.round(F.col("value") * 100).cast("long")),
        offset=F.col("event_id"), key=F.col("user_id"), partition=F.lit("events"),
    )
