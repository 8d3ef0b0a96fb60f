"""Running values, ranks and range maxima over the whole arrival order, without sorting it in one task.

Arrival is cut into about sqrt(n) slices, ``SLICES`` at most, at quantiles of the rows: a wild ordinal or a burst changes no slice's size.  A window works
within each slice; what a slice takes from those before it comes from a window over one row for each slice.  The rows are counted, and the quantiles found, over the order's
column alone, when an operator is applied.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

SLICES = 1 << 12


def cuts(df: DataFrame, by: Column) -> list[int]:
    """Where slices of about sqrt(n) rows begin, in order."""
    order = df.select(by.cast("double").alias("x"))
    wanted = max(1, min(SLICES, math.isqrt(order.count())))
    bounds = order.approxQuantile("x", [k / wanted for k in range(1, wanted)], 1 / (4 * wanted)) if wanted > 1 else []
    return sorted({int(b) for b in bounds})


def sliced(df: DataFrame, by: Column, bounds: list[int] | None = None) -> DataFrame:
    """df plus ``__slice``, which follows ``by`` (a whole number that orders the rows; nulls come first)."""
    bounds = cuts(df, by) if bounds is None else bounds
    return df.withColumn("__slice", F.when(by.isNull(), F.lit(-1)).otherwise(below(by, bounds)).cast("long"))


def below(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are less than the value, by halving."""
    if not bounds:
        return F.lit(0)
    array = F.expr(f"array({', '.join(f'{b}L' for b in bounds)})")
    steps = F.expr(f"array({', '.join(str(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1))})")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(array, at + step - 1) < value), at + step).otherwise(at))


def running_max(df: DataFrame, value: Column, name: str, order: tuple[str, ...] = ("offset",), bounds: list[int] | None = None) -> DataFrame:
    """df plus ``name``: the greatest value so far in arrival order, the row's own included."""
    rows = sliced(df, F.col(order[0]), bounds).withColumn("__value", value)
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("__slice").agg(F.max("__value").alias("m")).select("__slice", F.max("m").over(before).alias("__carried"))
    so_far = Window.partitionBy("__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.withColumn("__local", F.max("__value").over(so_far)).join(carried, "__slice")
    return joined.withColumn(name, F.greatest("__local", "__carried")).select(*df.columns, name)


def ranked(df: DataFrame, name: str, order: tuple[str, ...] = ("offset",), by: Column | None = None) -> DataFrame:
    """df plus ``name``: 0, 1, 2, ... in the given order.  ``by`` is a whole number that the order follows first."""
    rows = sliced(df, F.col(order[0]) if by is None else by)
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("__slice").agg(F.count("*").alias("n")).select("__slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__slice").orderBy(*order)) - 1
    return rows.withColumn("__local", local).join(carried, "__slice").withColumn(name, (F.col("__before") + F.col("__local")).cast("long")).select(*df.columns, name)


class Maxima:
    """Maxima of any run of an array, from those of runs of 1, 2, 4, ... places (two of which cover it)."""

    def __init__(self, values: np.ndarray):
        self.level = [np.nan_to_num(values.astype(float), nan=-np.inf)]
        while 2 << len(self.level) - 1 <= len(values):
            half = 1 << len(self.level) - 1
            self.level.append(np.maximum(self.level[-1][:-half], self.level[-1][half:]))

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The greatest of the places from low up to, not with, high; minus infinity for none."""
        out = np.full(len(low), -np.inf)
        k = np.where(high > low, np.floor(np.log2(np.maximum(high - low, 1))).astype(int), -1)
        for j, level in enumerate(self.level):
            at = np.flatnonzero(k == j)
            out[at] = np.maximum(level[low[at]], level[high[at] - (1 << j)])
        return out


def reached(rows: DataFrame, value: str, upto: str, least: str, *, bounds: list[int], plain: DataFrame) -> DataFrame:
    """The rows (with ``offset``) for which a row after them, up to the offset ``upto``, has a ``value`` of at least ``least``; rows without ``upto`` don't count.

    Where both ends lie in one slice, that slice's task looks up the range's maximum.  Else it is made of the rest of the first slice, the start of the last, and the whole
    slices between, whose maxima (``SLICES`` numbers at most) go to every task.  ``plain`` holds the same offsets and values, at less cost; ``bounds`` cut them.
    """
    stored = sliced(rows, F.col("offset"), bounds)
    within = Window.partitionBy("__slice").orderBy("offset")
    ends = stored.select(F.col("offset").alias("__upto"), F.col("__slice").alias("__end"), F.max(value).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("__head"))
    tails = stored.withColumn("__tail", F.max(value).over(within.rowsBetween(1, Window.unboundedFollowing)))
    asked = tails.join(ends, F.col(upto) == F.col("__upto"), "left")
    found = sliced(plain, F.col("offset"), bounds).groupBy("__slice").agg(F.max(value).alias("m")).orderBy("__slice").collect()
    numbers, maxima = np.array([r["__slice"] for r in found], np.int64), np.array([np.nan if r["m"] is None else r["m"] for r in found], float)
    schema = rows.schema
    number = lambda b, c: np.nan_to_num(b.column(c).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)

    def across(batches):
        table = Maxima(maxima)
        for b in batches:
            low, high = (np.searchsorted(numbers, b.column(c).to_numpy(), side=side) for c, side in (("__slice", "right"), ("__end", "left")))
            most = np.maximum(np.maximum(number(b, "__tail"), number(b, "__head")), table.between(low, high))
            yield b.select(schema.names).filter(pa.array(most >= number(b, least)))

    def inside(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("offset")
        runs = Maxima(table.column(value).to_numpy(zero_copy_only=False))
        at = np.flatnonzero(table.column("__ask").to_numpy(zero_copy_only=False))
        mine = table.take(pa.array(at))
        high = np.searchsorted(table.column("offset").to_numpy(), mine.column(upto).to_numpy(zero_copy_only=False).astype(np.int64), side="right")
        return mine.select(schema.names).filter(pa.array(runs.between(at + 1, high) >= number(mine, least)))

    far = asked.where(F.col("__end") > F.col("__slice")).mapInArrow(across, schema)
    near = asked.withColumn("__ask", F.coalesce(F.col("__end") == F.col("__slice"), F.lit(False))).groupBy("__slice").applyInArrow(inside, schema)
    return far.unionByName(near)
