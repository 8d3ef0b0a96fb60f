"""Folds over each key's records in arrival order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..errors import attempted, dead_letters, marked
from ..flow import Flow, Operator
from ..plans.arrival import ranked
from .folding import Fold, folded


def by_arrival():
    """A key's records in order of arrival (windows need a session, so none is made on import)."""
    return Window.partitionBy("key").orderBy("offset")


def so_far():
    """A key's records up to and with the current one."""
    return by_arrival().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def scan_op(aggregate: Column | Callable, seed=None, name: str = "value", result: str | None = None, *, combine: Callable[[Column, Column], Column] | None = None,
            on_error: str = "fail_job", retries: int = 0, states: DataFrame | None = None) -> Operator:
    """A running value for each record.

    An aggregate expression (``F.sum("n")``) runs as a window function; a seed needs ``combine``, which joins it to the aggregate (for a sum: their sum).  A callable
    ``(state, record) -> state`` with a seed is folded in arrival order, streaming over the key's records, and ``result`` is the type of its state.  An item on
    which it fails leaves the state alone; by policy it stops the job or goes to the dead letters.  ``states`` (key, state) are where a job before this one
    stopped: those keys go on from there instead of the seed.
    """
    if isinstance(aggregate, Column):
        if (seed is None) != (combine is None):
            raise ValueError("a seed and combine go together")
        value = aggregate.over(so_far())
        return lambda flow: flow.with_df(flow.df.withColumn(name, value if combine is None else combine(F.lit(seed), value)))

    resumed = states is not None

    class Scan(Fold):
        def step(self, held, record):
            if held is None:
                held = (seed if not resumed or record["__state"] is None else record["__state"]["state"],)
            ok, new, error, _ = attempted(aggregate, held[0], record, retries=retries)
            return ((new,) if ok else held), [(new, error)]

    kind = T._parse_datatype_string(result) if isinstance(result, str) else result
    found = T.StructType([T.StructField(name, kind), T.StructField("__error", T.StringType())])

    def run(flow: Flow) -> Flow:
        df = flow.df
        if states is not None:
            held = states.select(F.col("key").alias("__key"), F.struct(F.col("state").cast(kind).alias("state")).alias("__state"))
            df = df.join(held, F.col("key").eqNullSafe(F.col("__key")), "left").drop("__key")
        done = folded(df, Scan(), found)
        done = done.drop("__state") if states is not None else done
        good = F.col("__error").isNull()
        if on_error == "fail_job":
            return flow.with_df(done.where(good | F.raise_error(marked("scan_op", F.col("__error"))).cast("boolean")).drop("__error"))
        if on_error not in ("skip", "retry"):
            raise ValueError(f"unknown policy {on_error!r}")
        done = done.persist()
        failed = dead_letters(done.where(~good), "scan_op", F.col("__error")).drop("__error", *([] if name in flow.df.columns else [name]))
        return flow.with_df(done.where(good).drop("__error")).emit("dlq", failed).holding(done)

    return run


def last_states(df: DataFrame, name: str = "value") -> DataFrame:
    """(key, state): each key's last value, for the ``states`` of a later :func:`scan_op`."""
    return df.groupBy("key").agg(F.max_by(F.col(name), F.col("offset")).alias("state"))


def distinct_until_changed(ident: Column | str) -> Operator:
    """Records whose ident differs from that of the key's record before; null is a value."""

    def run(flow: Flow) -> Flow:
        column = F.col(ident) if isinstance(ident, str) else ident
        rows = flow.df.withColumn("__ident", column)
        rows = rows.withColumns({"__before": F.lag("__ident").over(by_arrival()), "__first": F.row_number().over(by_arrival()) == 1})
        return flow.with_df(rows.where(F.col("__first") | ~F.col("__ident").eqNullSafe(F.col("__before"))).drop("__ident", "__before", "__first"))

    return run


def buffer_count(size: int) -> Operator:
    """Batches of ``size`` records over all keys by arrival, the last one maybe shorter: ``items`` in order, engine columns of the last item."""
    if size < 1:
        raise ValueError("size must be positive")

    def run(flow: Flow) -> Flow:
        engine = ["offset", "partition", "key", "event_time", "ingest_time", "headers"]
        payload = [c for c in flow.df.columns if c not in engine]
        rows = ranked(flow.df, "__rank").withColumn("batch", F.floor(F.col("__rank") / size).cast("long"))
        items = F.array_sort(F.collect_list(F.struct("offset", "event_time", *payload)))
        last = F.max_by(F.struct(*engine), F.col("__rank")).alias("__last")
        return flow.with_df(rows.groupBy("batch").agg(items.alias("items"), last).select("__last.*", "batch", "items"))

    return run
