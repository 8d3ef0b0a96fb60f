"""Operators on the time between a key's records: event time, else ingest time."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..flow import Flow, Operator
from ..functions.columns import event_micros, from_micros
from ..functions.durations import micros
from ..plans.arrival import cuts, reached, running_max
from .folding import Sample, Throttle, chosen
from .keyed import by_arrival

Duration = str | int | float | timedelta


def throttle(interval: Duration) -> Operator:
    """The key's first record, then each that comes at least an interval after the last that passed."""
    return lambda flow: flow.with_df(chosen(flow.df.withColumn("__t", event_micros()), Throttle(micros(interval)), "__t").drop("__t"))


def sample(interval: Duration) -> Operator:
    """From the key's first record on, the first record of each interval that follows (an interval begins with the record that passed), and the key's last."""

    def run(flow: Flow) -> Flow:
        rows = flow.df.withColumns({"__t": event_micros(), "__last": F.lead("offset").over(by_arrival()).isNull()})
        ticks = chosen(rows, Sample(micros(interval)), "__t").where(~F.col("__last"))
        return flow.with_df(ticks.unionByName(rows.where("__last")).drop("__t", "__last"))

    return run


def debounce(interval: Duration, *, in_order: bool = False) -> Operator:
    """A key's record once the stream has moved an interval past it before the key's next record takes its place; the key's last always.

    ``in_order`` promises that times never fall: then the next record of the key decides.  Otherwise the stream's running maximum decides, except for
    records that came an interval late, which are compared with what lies between them and their successor.
    """
    gap = micros(interval)

    def run(flow: Flow) -> Flow:
        rows = flow.df.withColumn("__t", event_micros())
        if in_order:
            nxt = F.lead("__t").over(by_arrival())
            return flow.with_df(rows.withColumn("__next", nxt).where(F.col("__next").isNull() | (F.col("__next") - F.col("__t") >= gap)).drop("__t", "__next"))
        base, bounds = rows, cuts(rows, F.col("offset"))
        rows = running_max(rows, F.col("__t"), "__high", bounds=bounds)
        rows = rows.withColumns({"__next": F.lead("offset").over(by_arrival()), "__reach": F.lead("__high").over(by_arrival())})
        plain = rows.where(F.col("__next").isNull() | ((F.col("__high") < F.col("__t") + gap) & (F.col("__reach") >= F.col("__t") + gap)))
        # the maximum was already there: only what lies between can tell
        rows = rows.withColumn("__asks", F.when(F.col("__next").isNotNull() & (F.col("__high") >= F.col("__t") + gap), F.col("__next"))).withColumn("__least", F.col("__t") + gap)
        between = reached(rows, "__t", "__asks", "__least", bounds=bounds, plain=base)
        return flow.with_df(plain.unionByName(between.select(*plain.columns)).drop("__t", "__high", "__next", "__reach"))

    return run


def timeout(interval: Duration) -> Operator:
    """A marker (``timeout`` true, ``since``, ``at``) before each record that comes at least an interval after the key's record before it.

    Markers have no offset and no payload; ``position`` (the record's offset, and 0 for a marker, 1 for a record) keeps the order.
    """
    gap = micros(interval)

    def run(flow: Flow) -> Flow:
        rows = flow.df.withColumn("__t", event_micros()).withColumn("__before", F.lag("__t").over(by_arrival()))
        place = lambda k: F.struct(F.col("offset"), F.lit(k).alias("rank"))
        marker = rows.where(F.col("__t") - F.col("__before") >= gap).select(
            F.col("key"), F.col("event_time"), F.lit(True).alias("timeout"), from_micros(F.col("__before")).alias("since"), from_micros(F.col("__t")).alias("at"), place(0).alias("position")
        )
        return flow.with_df(rows.drop("__t", "__before").withColumns({"timeout": F.lit(False), "position": place(1)}).unionByName(marker, allowMissingColumns=True))

    return run
