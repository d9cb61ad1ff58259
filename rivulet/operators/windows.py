"""Window functions: frames by rows, fills, ranks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Aggregates that give the same in any order of a frame's rows.
ORDERLESS = ("count", "count_if", "sum", "avg", "mean", "min", "max", "any", "some", "every", "bool_and", "bool_or", "std", "stddev", "stddev_samp", "stddev_pop", "variance", "var_samp", "var_pop")


def ordered(by: list[str], ascending: bool | list[bool] = True) -> list[Column]:
    """Sort keys with nulls last in both directions."""
    flags = ascending if isinstance(ascending, list) else [ascending] * len(by)
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in zip(by, flags, strict=True)]


def window(partition: list[str], by: list[str], ascending: bool | list[bool] = True) -> WindowSpec:
    """A window whose attribute back, where it is sorted, is the same window from its end; rows that tie are in any order in both."""
    spec = Window.partitionBy(*partition)
    if not by:
        return spec
    out = spec.orderBy(*ordered(by, ascending))
    flags = ascending if isinstance(ascending, list) else [ascending] * len(by)
    out.back = spec.orderBy(*[F.col(c).desc_nulls_first() if up else F.col(c).asc_nulls_first() for c, up in zip(by, flags, strict=True)])
    return out


def rolling(agg: Column, spec: WindowSpec, size: int, min_periods: int | None = None, center: bool = False) -> Column:
    """An aggregate over the last size rows; null where fewer than min_periods are there."""
    after = (size - 1) // 2 if center else 0
    frame = spec.rowsBetween(-(size - 1 - after), after)
    return F.when(F.count(F.lit(1)).over(frame) >= (size if min_periods is None else min_periods), agg.over(frame))


def expanding(agg: Column, spec: WindowSpec, min_periods: int = 1) -> Column:
    frame = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.when(F.count(F.lit(1)).over(frame) >= min_periods, agg.over(frame))


def framed(agg: Column, spec: WindowSpec, start: int | None, end: int | None, mode: str = "rows") -> Column:
    """An aggregate over rows, or values of the one numeric sort key, from start to end around the current one; None: without bound.

    Spark computes a frame without an end anew for each row, which grows with the square of a
    partition; from the window's end the same frame has no start, and is carried on from row to row.
    """
    low = Window.unboundedPreceding if start is None else start
    high = Window.unboundedFollowing if end is None else end
    if mode not in ("rows", "range"):
        raise ValueError("mode is rows or range")
    if start is not None and end is None and hasattr(spec, "back") and _orderless(agg):
        spec, low, high = spec.back, Window.unboundedPreceding, -start
    return agg.over(spec.rowsBetween(low, high) if mode == "rows" else spec.rangeBetween(low, high))


def _orderless(agg: Column) -> bool:
    name = re.match(r"Column<'(\w+)\(", str(agg))
    return bool(name) and name.group(1) in ORDERLESS


def ffill(c: Column, spec: WindowSpec) -> Column:
    """The last value that isn't null, up to this row."""
    return F.last(c, ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def bfill(c: Column, spec: WindowSpec) -> Column:
    """The next value that isn't null, from this row on; see framed for the direction."""
    if hasattr(spec, "back"):
        return ffill(c, spec.back)
    return F.first(c, ignorenulls=True).over(spec.rowsBetween(Window.currentRow, Window.unboundedFollowing))


def drop_duplicates(df: DataFrame, subset: list[str], keep: str | bool = "first", by: list[str] | None = None, ascending: bool = True) -> DataFrame:
    """One row for each combination of subset: the first or last in an order, or none that repeats."""
    if keep is False:
        n = F.count(F.lit(1)).over(Window.partitionBy(*subset))
        return df.withColumn("_n", n).where("_n = 1").drop("_n")
    spec = window(subset, by or subset, ascending if keep == "first" else not ascending)
    return df.withColumn("_n", F.row_number().over(spec)).where("_n = 1").drop("_n")
