"""Event-time windows, watermarks and late records, exact by arrival order.

A watermark is a column: the greatest event time that had arrived with the record, less a bound.  A window operator splits off records
that are older than their watermark (side table ``late``); the panes of the others need only a group by, since a record that isn't late
can't belong to a pane that the watermark has closed.  ``allowed_lateness`` therefore changes when a stream emits a pane, not what is in it.

Panes have key, start and end (half open), the end as their event time, the offset, partition and headers of the record that arrived last, and
either ``items`` in order of arrival or the given aggregates, which are pushed into the group by.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..flow import Flow, Operator
from ..functions.columns import aligned, from_micros, micros_of
from ..functions.durations import micros
from ..plans.arrival import running_max
from ..schema import ENGINE

Duration = str | int | float | timedelta
Aggregates = Mapping[str, Column]


def assign_watermarks(bounded_out_of_orderness: Duration = "0s") -> Operator:
    """Add the column ``watermark``: over all keys and partitions, per record, never falling; records without event time don't move it."""
    bound = micros(bounded_out_of_orderness)

    def run(flow: Flow) -> Flow:
        rows = running_max(flow.df, micros_of(F.col("event_time")), "__high")
        return flow.with_df(rows.withColumn("watermark", from_micros(F.col("__high") - bound)).drop("__high"))

    return run


def split_late(flow: Flow, clock: datetime | None) -> Flow:
    """Give records without event time the clock's; divert the late ones."""
    now = F.current_timestamp() if clock is None else F.lit(clock)
    df = flow.df.withColumn("event_time", F.coalesce("event_time", now))
    if "watermark" not in df.columns:
        return flow.with_df(df)
    late = F.coalesce(F.col("event_time") < F.col("watermark"), F.lit(False))
    return flow.with_df(df.where(~late)).emit("late", df.where(late))


def payload_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ENGINE and c != "watermark" and not c.startswith("__")]


def panes(rows: DataFrame, keys: list[str], start: Column, end: Column, aggregates: Aggregates | None) -> DataFrame:
    """One row for each pane; ``keys`` name the pane, start and end are aggregates or keys."""
    last = F.max_by(F.struct("offset", "partition", "ingest_time", "headers"), F.col("offset")).alias("__last")
    if aggregates is None:
        aggregates = {"items": F.array_sort(F.collect_list(F.struct("offset", "event_time", *payload_of(rows))))}
    grouped = rows.groupBy(*keys).agg(last, start.alias("__from"), end.alias("__to"), *(c.alias(k) for k, c in aggregates.items()))
    return grouped.select(
        "__last.offset", "__last.partition", "key", from_micros(F.col("__to")).alias("event_time"), "__last.ingest_time", "__last.headers",
        from_micros(F.col("__from")).alias("start"), from_micros(F.col("__to")).alias("end"), *aggregates,
    )


def tumbling_window(size: Duration, aggregates: Aggregates | None = None, *, allowed_lateness: Duration = "0s", clock: datetime | None = None) -> Operator:
    """Panes [start, start + size), aligned to the epoch."""
    micros(allowed_lateness)
    n = micros(size)

    def run(flow: Flow) -> Flow:
        out = split_late(flow, clock)
        rows = out.df.withColumn("__start", aligned(micros_of(F.col("event_time")), n))
        return out.with_df(panes(rows, ["key", "__start"], F.first("__start"), F.first("__start") + n, aggregates))

    return run


def sliding_window(size: Duration, slide: Duration, aggregates: Aggregates | None = None, *, allowed_lateness: Duration = "0s", clock: datetime | None = None) -> Operator:
    """The latest start at or before the record, and as many starts before it as whole slides fit the size; records in gaps (slide over size) are in no pane."""
    micros(allowed_lateness)
    n, step = micros(size), micros(slide)

    def run(flow: Flow) -> Flow:
        out = split_late(flow, clock)
        t = micros_of(F.col("event_time"))
        starts = F.transform(F.sequence(F.lit(0), F.lit(max(n // step, 1) - 1)), lambda i: aligned(t, step) - i.cast("long") * step)
        rows = out.df.withColumn("__start", F.explode(F.filter(starts, lambda s: t < s + n)))
        return out.with_df(panes(rows, ["key", "__start"], F.first("__start"), F.first("__start") + n, aggregates))

    return run


def session_window(gap: Duration, aggregates: Aggregates | None = None, *, allowed_lateness: Duration = "0s", clock: datetime | None = None) -> Operator:
    """A record more than a gap after all of its key so far begins a session; a session ends a gap after its latest record."""
    micros(allowed_lateness)
    g = micros(gap)

    def run(flow: Flow) -> Flow:
        out = split_late(flow, clock)
        order = Window.partitionBy("key").orderBy("offset")
        rows = out.df.withColumn("__t", micros_of(F.col("event_time")))
        before = F.max("__t").over(order.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("__new", F.when(F.col("__t") - before > g, 1).otherwise(0))
        rows = rows.withColumn("__session", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return out.with_df(panes(rows, ["key", "__session"], F.min("__t"), F.max("__t") + g, aggregates))

    return run
