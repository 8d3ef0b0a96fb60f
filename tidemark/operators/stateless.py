"""Projections, filters, validation, headers, limits, and flows that meet or part.

Expressions come first: they stay in the plan that the optimiser sees.  A Python callable is the second way, run in
Arrow batches under an error policy (``fail_job``, ``skip`` or ``retry``; the last two both divert to the dead letters).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import called, dead_letters, guarded, marked
from ..flow import Flow, Operator
from ..functions.columns import event_micros
from ..plans.arrival import ranked
from ..schema import ENGINE

Expressions = Mapping[str, "Column | str"]


def _column(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def map_op(columns: Expressions | Callable[[dict], dict], schema: str | T.StructType | None = None, *, on_error: str = "fail_job", retries: int = 0) -> Operator:
    """New values for some columns of the record, engine columns included; the rest stays.

    A callable gets the record as a dict and gives a dict of the fields in ``schema``.
    """
    if isinstance(columns, Mapping):
        return lambda flow: flow.with_df(flow.df.withColumns({k: _column(v) for k, v in columns.items()}))
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(flow: Flow) -> Flow:
        use = lambda df: df.withColumns({f.name: F.col(f"__call.value.{f.name}") for f in fields}).drop("__call")
        return guarded(flow, "map_op", called(flow.df, columns, fields, retries=retries), use, on_error)

    return run


def map_payload(columns: Expressions | Callable[[dict], dict], schema: str | T.StructType | None = None, *, on_error: str = "fail_job", retries: int = 0) -> Operator:
    """A new payload: the engine columns stay, the record's own columns are replaced.  Failures are those of ``map_op``."""
    if isinstance(columns, Mapping):
        return lambda flow: flow.with_df(flow.df.select(*(c for c in ENGINE if c in flow.df.columns), *(_column(v).alias(k) for k, v in columns.items())))
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(flow: Flow) -> Flow:
        engine = [c for c in ENGINE if c in flow.df.columns]
        use = lambda df: df.select(*engine, *(F.col(f"__call.value.{f.name}").alias(f.name) for f in fields))
        payload = lambda r: columns({k: r[k] for k in r if k not in ENGINE})
        return guarded(flow, "map_op", called(flow.df, payload, fields, retries=retries), use, on_error)

    return run


def flat_map(elements: Column | str | Callable[[dict], list], name: str, element: str | T.DataType | None = None, *, on_error: str = "fail_job", retries: int = 0) -> Operator:
    """One record for each element of an array, as column ``name``; empty and null arrays give none."""
    if callable(elements) and not isinstance(elements, Column):
        kind = T._parse_datatype_string(element) if isinstance(element, str) else element

        def run(flow: Flow) -> Flow:
            use = lambda df: df.withColumn("__each", F.explode("__call.value")).withColumn(name, F.col("__each")).drop("__call", "__each")
            calls = called(flow.df, lambda r: list(elements(r) or ()), T.ArrayType(kind), retries=retries)
            return guarded(flow, "flat_map", calls, use, on_error)

        return run
    return lambda flow: flow.with_df(flow.df.withColumn("__each", F.explode(_column(elements))).withColumn(name, F.col("__each")).drop("__each"))


def tap(effect: Callable[[dict], object] | None = None, *, observe: Mapping[str, Column] | None = None, name: str = "tap", on_error: str = "fail_job", retries: int = 0) -> Operator:
    """Records pass unchanged.  ``observe`` collects metrics in the plan; a callable is run on each record, and with ``skip`` a failing one diverts the record.

    As with any task, effects repeat when Spark computes a record again.
    """
    if observe:
        return lambda flow: flow.with_df(flow.df.observe(name, *(c.alias(k) for k, c in observe.items())))

    def run(flow: Flow) -> Flow:
        calls = called(flow.df, lambda r: effect(r) and None, T.BooleanType(), retries=retries)
        return guarded(flow, "tap", calls, lambda df: df.drop("__call"), on_error)

    return run


def filter_op(condition: Column | str | Callable[[dict], bool], *, on_error: str = "fail_job", retries: int = 0) -> Operator:
    """Records for which the condition holds; null doesn't."""
    if callable(condition) and not isinstance(condition, Column):

        def run(flow: Flow) -> Flow:
            calls = called(flow.df, lambda r: bool(condition(r)), T.BooleanType(), retries=retries)
            return guarded(flow, "filter_op", calls, lambda df: df.where("__call.value").drop("__call"), on_error)

        return run
    return lambda flow: flow.with_df(flow.df.where(_column(condition)))


def validate(condition: Column | str | Callable[[dict], bool], *, on_invalid: str = "dlq") -> Operator:
    """Invalid records (false, null or an exception) go to the dead letters; with ``fail_job`` they stop the job."""

    def run(flow: Flow) -> Flow:
        df = flow.df
        if callable(condition) and not isinstance(condition, Column):
            df = called(df, lambda r: bool(condition(r)), T.BooleanType(), retries=0)
            if on_invalid != "fail_job":
                df = df.persist()
                flow = flow.holding(df)
            good, error = F.col("__call.ok") & F.col("__call.value"), F.coalesce(F.col("__call.error"), F.lit("invalid"))
        else:
            good, error = F.coalesce(_column(condition), F.lit(False)), F.lit("invalid")
        if on_invalid == "fail_job":
            return flow.with_df(df.where(good | F.raise_error(marked("validate", error)).cast("boolean")).drop("__call"))
        return flow.with_df(df.where(good).drop("__call")).emit("dlq", dead_letters(df.where(~good), "validate", error).drop("__call"))

    return run


def assign_trace_id(header: str = "trace_id") -> Operator:
    """A random id of 32 hex digits in the headers, unless one is there."""

    def run(flow: Flow) -> Flow:
        own = F.coalesce("headers", F.create_map().cast("map<string,string>"))
        new = F.map_concat(own, F.create_map(F.lit(header), F.regexp_replace(F.expr("uuid()"), "-", "")))
        return flow.with_df(flow.df.withColumn("headers", F.when(F.map_contains_key(own, header), own).otherwise(new)))

    return run


def key_by(key: Column | str) -> Operator:
    """Set the key; rows move only when a keyed operator needs it."""
    return lambda flow: flow.with_df(flow.df.withColumn("key", _column(key)))


def identity() -> Operator:
    return lambda flow: flow


def take(n: int) -> Operator:
    """The first n records by arrival."""
    return lambda flow: flow.with_df(flow.df.where(F.lit(False)) if n <= 0 else flow.df.orderBy("offset").limit(n))


def skip(n: int) -> Operator:
    """All but the first n records by arrival.  Only the last of those n is looked up; nothing else is sorted."""

    def run(flow: Flow) -> Flow:
        if n <= 0:
            return flow
        first = flow.df.select("offset").orderBy("offset").limit(n).agg(F.max("offset").alias("__last"))
        return flow.with_df(flow.df.join(F.broadcast(first), F.col("offset") > F.col("__last")).drop("__last"))

    return run


def merge(*flows: Flow | DataFrame) -> Flow:
    """All records in order of time (event time, else ingest time), ties by source and arrival; numbered anew.  Side tables are joined."""
    frames = [f.df if isinstance(f, Flow) else f for f in flows]
    marked = [df.withColumns({"__source": F.lit(i), "__t": event_micros()}) for i, df in enumerate(frames)]
    union = marked[0]
    for df in marked[1:]:
        union = union.unionByName(df, allowMissingColumns=True)
    numbered = ranked(union, "__rank", ("__t", "__source", "offset"), by=F.col("__t"))
    out = Flow(numbered.withColumn("offset", F.col("__rank")).drop("__rank", "__source", "__t"))
    for f in flows:
        if isinstance(f, Flow):
            out = replace(out, held=out.held + f.held, pending=out.pending + f.pending)
        for name, df in (f.side if isinstance(f, Flow) else {}).items():
            out = out.emit(name, df)
    return out


def fan_out(*sinks: Callable[[DataFrame], object]) -> Operator:
    """Give the records to further sinks and pass them on.  They are written when the flow runs (in a job, or when it is collected), not when it is composed, and are computed once."""

    def run(flow: Flow) -> Flow:
        shared = flow.share()
        return replace(shared, pending=shared.pending + tuple((sink, shared.df) for sink in sinks))

    return run
