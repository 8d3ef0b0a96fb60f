"""Joins of records with tables and with each other.  Null keys match null keys.

Sides are not broadcast by hand: the optimiser does it where its size estimate allows, and shuffles otherwise.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..flow import Flow, Operator
from ..functions.columns import event_micros
from ..functions.durations import micros
from ..schema import ENGINE

Duration = str | int | float | timedelta


def _struct(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    return F.struct(*(c for c in df.columns if c not in without))


def join_table(table: DataFrame, *, how: str = "inner", key: str = "key") -> Operator:
    """Look the key up in a table: the row becomes column ``right``.  Of several rows of one key one counts, that of the greatest hash, so a record has one match at most.

    Misses go to the side table ``unmatched``; with ``left`` they stay, with a null ``right``.
    """

    def run(flow: Flow) -> Flow:
        row = _struct(table, (key,))
        rows = table.groupBy(F.col(key).alias("__key")).agg(F.max_by(row, F.xxhash64(row)).alias("right"))
        on = F.col("key").eqNullSafe(F.col("__key"))
        if how == "left":
            return flow.with_df(flow.df.join(rows, on, "left").drop("__key"))
        return flow.with_df(flow.df.join(rows, on).drop("__key")).emit("unmatched", flow.df.join(rows, on, "left_anti"))

    return run


def join_table_state(changes: DataFrame | str, *, how: str = "inner") -> Operator:
    """Look the key up in what a changelog (a table, or the name of one that :func:`upsert_table` keeps in this flow) had said by the time the record arrived (offsets of both sides are one order, a change before a record of the same offset).

    A change whose payload is all null removes its row.  Misses as in :func:`join_table`.
    """

    def run(flow: Flow) -> Flow:
        log = flow.side[f"table:{changes}"] if isinstance(changes, str) else changes
        payload = [c for c in log.columns if c not in ENGINE]
        present = F.coalesce(*(F.col(c).isNotNull() for c in payload), F.lit(False)) if len(payload) == 1 else F.greatest(*(F.col(c).isNotNull() for c in payload))
        log = log.select("key", "offset", F.lit(0).alias("__side"), F.struct(F.when(present, F.struct(*payload)).alias("row")).alias("__change"))
        rows = flow.df.select("key", "offset", F.lit(1).alias("__side"), F.struct(*(c for c in flow.df.columns if c not in ("key", "offset"))).alias("__record"))
        w = Window.partitionBy("key").orderBy("offset", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = log.unionByName(rows, allowMissingColumns=True).withColumn("__now", F.last("__change", ignorenulls=True).over(w)).where("__side = 1")
        found = both.select("key", "offset", "__record.*", F.col("__now.row").alias("right")).select(*flow.df.columns, "right")
        if how == "left":
            return flow.with_df(found)
        return flow.with_df(found.where("right is not null")).emit("unmatched", found.where("right is null").drop("right"))

    return run


def upsert_table(key: Column | None = None, *, state_id: str = "table") -> Operator:
    """Records pass, with their key set, and become the changelog of a table of this flow: ``join_table_state(state_id)`` sees it as it was when each record came, and
    ``as_table(flow.side["table:" + state_id])`` as it is in the end."""

    def run(flow: Flow) -> Flow:
        rows = flow.df if key is None else flow.df.withColumn("key", key)
        return flow.with_df(rows).with_side(flow.side | {f"table:{state_id}": rows})

    return run


def as_table(df: DataFrame, key: Column | None = None) -> DataFrame:
    """The latest row for each key of a changelog; a key whose latest payload is all null is gone."""
    rows = df if key is None else df.withColumn("key", key)
    payload = [c for c in rows.columns if c not in ENGINE]
    latest = rows.groupBy("key").agg(F.max_by(F.struct("offset", *payload), F.col("offset")).alias("__row")).select("key", "__row.*")
    gone = None
    for c in payload:
        gone = F.col(c).isNull() if gone is None else gone & F.col(c).isNull()
    return latest if gone is None else latest.where(~gone)


def _sides(flow: Flow, other: Flow | DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    right = other.df if isinstance(other, Flow) else other
    left = flow.df.withColumn("__lt", event_micros())
    right = right.withColumn("__rt", event_micros()).select(F.col("key").alias("__rkey"), "__rt", F.col("offset").alias("__ro"), _struct(right).alias("right"))
    # a key's records meet by slices of time, so that a frequent key is many small groups
    width = max(window, 1)
    left = left.withColumn("__slice", F.floor(F.col("__lt") / width))
    right = right.withColumn("__rslice", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("__rt") / width) + d)))
    return left, right


def join_stream(other: Flow | DataFrame, window: Duration, *, how: str = "inner") -> Operator:
    """Pairs of one key whose times (event time, else ingest time) are at most a window apart; the right record is column ``right``.

    A pair's engine columns are those of the record that came later (times decide, the left first among equals).  ``position`` orders the results as they arise: by the later
    record's time and side, its offset, then the other's.  ``left`` is eager: a left record for which nothing had arrived yet also gives a
    row with a null ``right``, even if matches follow.  Both sides are taken to arrive in order of time.
    """
    w = micros(window)

    def run(flow: Flow) -> Flow:
        left, right = _sides(flow, other, w)
        on = F.col("key").eqNullSafe(F.col("__rkey")) & (F.col("__slice") == F.col("__rslice")) & (F.abs(F.col("__lt") - F.col("__rt")) <= w)
        place = lambda t, side, own, their: F.struct(t.alias("time"), F.lit(side).alias("side"), own.alias("offset"), their.alias("other"))
        none = F.lit(None).cast("long")
        pairs = left.join(right, on)
        later = F.col("__rt") >= F.col("__lt")
        position = F.when(later, place(F.col("__rt"), 1, F.col("__ro"), F.col("offset"))).otherwise(place(F.col("__lt"), 0, F.col("offset"), F.col("__ro")))
        pairs = pairs.withColumn("position", position).withColumns({c: F.when(later, F.col(f"right.{c}")).otherwise(F.col(c)) for c in ENGINE if c in flow.df.columns and c != "key"})
        pairs = pairs.drop("__lt", "__rt", "__slice", "__rslice", "__rkey", "__ro")
        if how != "left":
            return flow.with_df(pairs)
        lone = left.join(right, on & (F.col("__rt") < F.col("__lt")), "left_anti").withColumn("position", place(F.col("__lt"), 0, F.col("offset"), none)).drop("__lt", "__slice")
        return flow.with_df(pairs.unionByName(lone, allowMissingColumns=True))

    return run
