"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def micros_of(ts: Column) -> Column:
    """A timestamp as microseconds since the epoch (without a zone: taken as UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(n: Column) -> Column:
    return F.timestamp_micros(n.cast("long"))


def aligned(t: Column, size: int) -> Column:
    """The latest multiple of size that isn't after t, both in microseconds (also before the epoch)."""
    return t - F.pmod(t, F.lit(size))


def event_micros() -> Column:
    """A record's own time: event time, else ingest time."""
    return micros_of(F.coalesce(F.col("event_time"), F.col("ingest_time")))


def all_of(df, *, without: tuple[str, ...] = ()) -> list[str]:
    return [c for c in df.columns if c not in without]
