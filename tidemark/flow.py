"""A flow: the main table of records, and the side tables that operators split off it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame

from .failures import told

#: What an operator is: a function from flow to flow.
Operator = Callable[["Flow"], "Flow"]


@dataclass(frozen=True)
class Flow:
    """``side`` holds what left the main path: ``late``, ``unmatched``, ``dlq`` and any other name; ``source`` is what it is read from, if that is known.

    ``held`` are persisted tables, and ``pending`` the sinks that operators have been given within the flow, each with its table; a job serves and frees them.
    """

    df: DataFrame
    side: dict[str, DataFrame] = field(default_factory=dict)
    source: object | None = None
    held: tuple[DataFrame, ...] = ()
    pending: tuple[tuple[object, DataFrame], ...] = ()

    def pipe(self, *ops: Operator) -> Flow:
        return compose(*ops)(self)

    def with_df(self, df: DataFrame) -> Flow:
        return replace(self, df=df)

    def with_side(self, side: dict[str, DataFrame]) -> Flow:
        return replace(self, side=side)

    def emit(self, name: str, df: DataFrame) -> Flow:
        """Add rows to a side table."""
        before = self.side.get(name)
        return self.with_side(self.side | {name: df if before is None else before.unionByName(df, allowMissingColumns=True)})

    def holding(self, *tables: DataFrame) -> Flow:
        return replace(self, held=self.held + tables)

    def share(self) -> Flow:
        """Keep the records, so that several readers don't compute them again."""
        kept = self.df.persist()
        return self.with_df(kept).holding(kept)

    def release(self) -> None:
        """Let go of what is kept."""
        for df in self.held:
            df.unpersist()

    def serve(self) -> None:
        """Write to the sinks within the flow."""
        for sink, df in self.pending:
            (sink.write if hasattr(sink, "write") else sink)(df)

    def collect(self) -> list:
        """All records by arrival, for tests and small results."""
        try:
            self.serve()
            return (self.df.orderBy("offset") if "offset" in self.df.columns else self.df).collect()
        except Exception as e:
            raise told(e) from e

    def subscribe(self, on_next: Callable[[object], object], on_error: Callable[[BaseException], object] | None = None, on_complete: Callable[[], object] | None = None) -> None:
        """Give each record to the driver, one after the other by arrival."""
        try:
            self.serve()
            for row in (self.df.orderBy("offset") if "offset" in self.df.columns else self.df).toLocalIterator():
                on_next(row)
        except Exception as e:
            if on_error is None:
                raise told(e) from e
            on_error(told(e))
            return
        if on_complete:
            on_complete()


def compose(*ops: Operator) -> Operator:
    """Left to right; none is the identity."""
    return lambda flow: reduce(lambda f, op: op(f), ops, flow)


def operator(fn: Callable[..., DataFrame]) -> Callable[..., Operator]:
    """Make an operator factory of a function ``(df, *args) -> df``."""

    def factory(*args, **kwargs) -> Operator:
        return lambda flow: flow.with_df(fn(flow.df, *args, **kwargs))

    factory.__name__, factory.__doc__ = fn.__name__, fn.__doc__
    return factory
