"""Reshaping, binning and scaling. Parameters come from one-row aggregates; rows are never joined to them by key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grouping

BIN = "struct<lower:double,upper:double,bounds:string>"


#: Labels that are looked up and become columns: more raise a ValueError.
MOST_LABELS = 10_000


def _labels(df: DataFrame, column: str) -> list:
    found = [r[0] for r in df.select(F.col(f"`{column}`")).distinct().limit(MOST_LABELS + 1).collect()]
    if len(found) > MOST_LABELS:
        raise ValueError(f"{column} has more than {MOST_LABELS} values: they can't all become columns")
    return sorted(found, key=lambda v: (v is not None, v))


def stack(df: DataFrame, index: list[str], columns: list[str], dropna: bool = True) -> DataFrame:
    """Columns to rows: __stacked_index names the column, __stacked holds its value."""
    out = df.unpivot(index, columns, "__stacked_index", "__stacked")
    return out.where("__stacked IS NOT NULL") if dropna else out


def unstack(df: DataFrame, index: list[str], level: str, columns: list[str], values: list | None = None, fill_value=None, aggregation: str = "max") -> DataFrame:
    """Values of a level to columns <value>__<column>. Without values they are looked up, which runs a query."""
    if values is None:
        values = _labels(df, level)
    if any(v is None for v in values):
        raise ValueError("a null label can't become a column")
    f = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count, "mean": F.avg}[aggregation]
    picks = [f(F.when(F.col(level) == F.lit(v), F.col(c))).alias(f"{v}__{c}") for v in values for c in columns]
    out = df.groupBy(*index).agg(*picks)
    return out.fillna(fill_value) if fill_value is not None else out


def get_dummies(df: DataFrame, column: str, values: list | None = None, prefix: str | None = None, sep: str = "_", dummy_na: bool = False) -> DataFrame:
    """One 0/1 column for each value."""
    if values is None:
        values = [v for v in _labels(df, column) if v is not None]
    name = column if prefix is None else prefix
    flags = {f"{name}{sep}{v}": F.coalesce((F.col(column) == F.lit(v)).cast("long"), F.lit(0)) for v in values}
    if dummy_na:
        flags[f"{name}{sep}nan"] = F.col(column).isNull().cast("long")
    return df.withColumns(flags).drop(column)


def _with(df: DataFrame, **params: Column) -> DataFrame:
    """The rows with one-row aggregates of the same frame beside them."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(k) for k, c in params.items()])))


def scale(df: DataFrame, columns: list[str], with_mean: bool = True, with_std: bool = True) -> DataFrame:
    """(x - mean) / population standard deviation; a column of one value becomes 0, as it isn't divided."""
    out = _with(df, **{f"_m_{c}": F.avg(F.col(f"`{c}`")) for c in columns}, **{f"_s_{c}": F.stddev_pop(F.col(f"`{c}`")) for c in columns})
    picks = {c: (F.col(c) - (F.col(f"_m_{c}") if with_mean else F.lit(0.0))) / (F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0)) if with_std else F.lit(1.0)) for c in columns}
    return out.select(*[picks[c].alias(c) if c in picks else F.col(f"`{c}`") for c in df.columns])


def minmax_scale(df: DataFrame, columns: list[str], feature_range: tuple[float, float] = (0, 1)) -> DataFrame:
    low, high = feature_range
    out = _with(df, **{f"_a_{c}": F.min(F.col(f"`{c}`")) for c in columns}, **{f"_b_{c}": F.max(F.col(f"`{c}`")) for c in columns})
    picks = {c: (F.col(c) - F.col(f"_a_{c}")) / F.coalesce(F.nullif((F.col(f"_b_{c}") - F.col(f"_a_{c}")).cast("double"), F.lit(0.0)), F.lit(1.0)) * F.lit(float(high - low)) + F.lit(float(low)) for c in columns}
    return out.select(*[picks[c].alias(c) if c in picks else F.col(f"`{c}`") for c in df.columns])


@dataclass(frozen=True)
class Scaler:
    """Shift and width of each column, learned on one frame and used on others."""

    parameters: dict[str, tuple[float, float]]
    low: float = 0.0
    high: float = 1.0

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], kind: str = "standard", with_mean: bool = True, with_std: bool = True, feature_range: tuple[float, float] = (0, 1)) -> Scaler:
        """kind: standard (mean and population standard deviation) or minmax. One row is read."""
        two = {"standard": (F.avg, F.stddev_pop), "minmax": (F.min, F.max)}[kind]
        row = df.agg(*[f(F.col(f"`{c}`")).cast("double") for c in columns for f in two]).first()
        found = {}
        for i, c in enumerate(columns):
            a, b = row[2 * i], row[2 * i + 1]
            if a is None:
                found[c] = (0.0, 1.0)
            elif kind == "standard":
                found[c] = (a if with_mean else 0.0, (b or 1.0) if with_std else 1.0)
            else:
                found[c] = (a, (b - a) or 1.0)
        return cls(found, *map(float, feature_range if kind == "minmax" else (0, 1)))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(f"`{c}`") - F.lit(a)) / F.lit(b) * F.lit(self.high - self.low) + F.lit(self.low) for c, (a, b) in self.parameters.items()})


def _bin_of(x: Column, edges: Column, right: bool) -> Column:
    """The interval of consecutive edges that holds x; null outside all of them."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.struct(F.element_at(edges, i).alias("lower"), F.element_at(edges, i + 1).alias("upper"), F.lit("(]" if right else "[)").alias("bounds")))
    holds = (lambda b: (x > b["lower"]) & (x <= b["upper"])) if right else (lambda b: (x >= b["lower"]) & (x < b["upper"]))
    return F.try_element_at(F.filter(pairs, holds), F.lit(1)).cast(BIN)


def cut(df: DataFrame, column: str, bins: int, right: bool = True, name: str = "range") -> DataFrame:
    """Bins of equal width; the outer edge is moved by a thousandth of the range, so the extreme value is inside."""
    out = _with(df, _a=F.min(F.col(column).cast("double")), _b=F.max(F.col(column).cast("double")))
    same = F.col("_a") == F.col("_b")
    low = F.when(same, F.col("_a") - F.when(F.col("_a") == 0, 0.001).otherwise(0.001 * F.abs("_a"))).otherwise(F.col("_a"))
    high = F.when(same, F.col("_b") + F.when(F.col("_b") == 0, 0.001).otherwise(0.001 * F.abs("_b"))).otherwise(F.col("_b"))
    step, extra = (high - low) / bins, F.when(same, 0.0).otherwise((high - low) * 0.001)
    edges = F.array(*[low + step * k - (extra if right and k == 0 else F.lit(0.0)) + (extra if not right and k == bins else F.lit(0.0)) if k < bins else high + (F.lit(0.0) if right else extra) for k in range(bins + 1)])
    return out.select(*[F.col(f"`{c}`") for c in df.columns], _bin_of(F.col(f"`{column}`"), edges, right).alias(name))


def qcut(df: DataFrame, column: str, q: int | list[float], name: str = "q_range") -> DataFrame:
    """Bins between quantiles, equal edges once, the lowest edge moved down by 0.001."""
    qs = [k / q for k in range(q + 1)] if isinstance(q, int) else list(q)
    out = df.crossJoin(F.broadcast(grouping.quantiles(df, [], column, qs, "_q")))  # one row
    edges = F.array_distinct(F.transform("_q", lambda x, i: F.when(i == 0, x - 0.001).otherwise(x)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], _bin_of(F.col(f"`{column}`"), edges, True).alias(name))


def histogram(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """(lower, upper, count of each column) for bins of equal width over all columns; the first bin holds its lower edge too, and empty bins stay."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    ends = df.agg(F.min(F.array_min(values)).alias("_a"), F.max(F.array_max(values)).alias("_b"))  # one row
    step = (F.col("_b") - F.col("_a")) / bins
    long = stack(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), [], columns).crossJoin(F.broadcast(ends))
    place = F.when(step == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil((F.col("__stacked") - F.col("_a")) / step) - 1)))
    counts = long.groupBy(place.cast("int").alias("_n")).pivot("__stacked_index", columns).agg(F.count(F.lit(1)))
    table = ends.select("_a", step.alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("_k"))
    out = table.join(counts, F.col("_k") == F.col("_n"), "left").orderBy("_k")
    return out.select((F.col("_a") + F.col("_s") * F.col("_k")).alias("lower"), (F.col("_a") + F.col("_s") * (F.col("_k") + 1)).alias("upper"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns])


def sample(df: DataFrame, percentage: float, seed: int) -> DataFrame:
    """Rows taken independently with a probability."""
    return df.sample(percentage / 100, seed)
