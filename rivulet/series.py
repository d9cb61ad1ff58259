"""A column of a frame with what is known of it: operators, accessors, aggregates, windows, and sinks."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import scalars, temporal
from .operators import grouping, windows

if TYPE_CHECKING:
    from .frame import Frame

INTEGERS = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True, eq=False)
class Series:
    """An expression over a frame's rows. A single series is one value, and fits beside any other."""

    frame: Frame
    column: Column
    name: str
    single: bool = False
    #: What puts the other columns that the expression needs beside the frame's rows.
    attach: tuple = ()

    @classmethod
    def from_value(cls, frame: Frame, value, name: str) -> Series:
        """A constant; lists become arrays and dicts structs, also of series."""
        return cls(frame, _literal(value), name)

    def attached(self) -> DataFrame:
        """The frame's rows with all columns that the expression needs."""
        return attach_all(self.frame.df, self.attach)

    @property
    def dtype(self) -> str:
        return self.attached().select(self.column.alias(self.name)).dtypes[0][1]

    def beside(self, frame: Frame) -> tuple[tuple, Column]:
        """What has to be attached to the frame, or to frames made of it, and the column that then holds the values.

        A series of the frame's own, or of a frame that it was made of, is an expression; one value
        is put beside all rows; other series are joined on the index, which must be the same.
        """
        if not self.single and (self.frame.df is frame.df or (self.frame.origin or self.frame) is (frame.origin or frame)):
            return self.attach, self.column
        hidden = f"__series_{uuid.uuid4().hex[:8]}"
        if self.single:
            one = self.attached().select(self.column.alias(hidden))  # one row
            return (lambda df: df.crossJoin(F.broadcast(one)),), F.col(hidden)
        if not frame.index or set(self.frame.index) != set(frame.index):
            raise ValueError("series of another frame need the same index to be joined on")
        keys = [f"{hidden}_{i}" for i in range(len(frame.index))]
        other = self.attached().select(*[F.col(f"`{c}`").alias(k) for c, k in zip(frame.index, keys, strict=True)], self.column.alias(hidden))
        same = [F.col(f"`{c}`") == F.col(k) for c, k in zip(frame.index, keys, strict=True)]
        return (lambda df: df.join(other, same, "left").drop(*keys),), F.col(hidden)

    def _new(self, column: Column, name: str | None = None, **changes) -> Series:
        return replace(self, column=column, name=name or self.name, **changes)

    def _both(self, other, made) -> Series:
        if isinstance(other, Series):
            attach, column = other.beside(self.frame)
            return replace(self, column=made(self.column, column), attach=(*self.attach, *[a for a in attach if a not in self.attach]))
        return self._new(made(self.column, other if isinstance(other, Column) else _literal(other)))

    # Arithmetic and comparison

    def __add__(self, other):
        text = self.dtype == "string"
        if self.dtype == "date":
            return self._both(other, temporal.date_plus)
        return self._both(other, (lambda a, b: F.concat(a, b)) if text else (lambda a, b: a + b))

    def __sub__(self, other):
        if self.dtype == "date":
            day = isinstance(other, Series) and other.dtype == "date"
            return self._both(other, temporal.date_minus_date if day else temporal.date_minus)
        return self._both(other, lambda a, b: a - b)

    def __mul__(self, other):
        return self._both(other, lambda a, b: a * b)

    def __truediv__(self, other):
        return self._both(other, (lambda a, b: a / b) if self.dtype.startswith("interval") else (lambda a, b: a.cast("double") / b))

    def __floordiv__(self, other):
        whole = self.dtype in INTEGERS and (isinstance(other, int) or isinstance(other, Series) and other.dtype in INTEGERS)
        return self._both(other, scalars.int_floordiv if whole else scalars.floordiv)

    def __mod__(self, other):
        whole = self.dtype in INTEGERS and (isinstance(other, int) or isinstance(other, Series) and other.dtype in INTEGERS)
        return self._both(other, scalars.int_mod if whole else scalars.mod)

    def __pow__(self, other):
        return self._both(other, scalars.power)

    def _shift(self, other, name: str):
        if self.dtype not in INTEGERS:
            raise TypeError(f"{self.dtype} can't be shifted")
        return self._both(other, lambda a, b: F.call_function(name, a, b.cast("int")))

    def __lshift__(self, other):
        return self._shift(other, "shiftleft")

    def __rshift__(self, other):
        return self._shift(other, "shiftright")

    def __eq__(self, other):
        return self._both(other, lambda a, b: a == b)

    def __ne__(self, other):
        return self._both(other, lambda a, b: a != b)

    def __lt__(self, other):
        return self._both(other, lambda a, b: a < b)

    def __le__(self, other):
        return self._both(other, lambda a, b: a <= b)

    def __gt__(self, other):
        return self._both(other, lambda a, b: a > b)

    def __ge__(self, other):
        return self._both(other, lambda a, b: a >= b)

    def __and__(self, other):
        return self._both(other, lambda a, b: a & b)

    def __or__(self, other):
        return self._both(other, lambda a, b: a | b)

    def __xor__(self, other):
        return self._both(other, lambda a, b: (a & ~b) | (~a & b))

    def __invert__(self):
        return self._new(~self.column)

    def equals(self, other) -> bool:
        """Whether this is the same expression of the same frame."""
        return isinstance(other, Series) and self.frame.df is other.frame.df and self.name == other.name and str(self.column) == str(other.column)

    # Values and nulls

    def astype(self, dtype: str) -> Series:
        if dtype in ("int64", "bigint", "int"):
            return self._new(scalars.to_int(self.column) if self.dtype in ("double", "float") else self.column.cast("bigint"))
        if dtype in ("bool", "boolean") and self.dtype != "string":
            return self._new(scalars.to_bool(self.column))
        if dtype == "timedelta":
            return self._new(temporal.parse_interval(self.column))
        if dtype == "uuid":
            return self._new(scalars.to_uuid(self.column))
        if dtype == "json":
            return self._new(scalars.json_canonical(self.column))
        if dtype == "time":
            return self._new(temporal.to_time(self.column))
        return self._new(self.column.cast({"float64": "double", "timestamp": "timestamp_ntz"}.get(dtype, dtype)))

    def isnull(self) -> Series:
        return self._new(self.column.isNull())

    def notnull(self) -> Series:
        return self._new(self.column.isNotNull())

    def fillna(self, value) -> Series:
        return self._both(value, lambda a, b: F.coalesce(a, b))

    def dropna(self) -> Series:
        return self._rows(lambda f, c: f[c.isNotNull()])

    def round(self, decimals: int = 0) -> Series:
        return self if self.dtype in INTEGERS else self._new(scalars.round_half_up(self.column, decimals))

    def exp(self) -> Series:
        return self._new(F.exp(self.column))

    def apply_func(self, func, *args, **options) -> Series:
        """func gets this series, and gives a series or a column."""
        out = func(self, *args, **options)
        return out if isinstance(out, Series) else self._new(out)

    # Frames and sinks

    def to_frame(self) -> Frame:
        """The index and this series."""
        index = [F.col(f"`{c}`") for c in self.frame.index if c != self.name]
        order = tuple(x for x in self.frame.order if x[0] in (*self.frame.index, self.name))
        return replace(self.frame, df=self.attached().select(*index, self.column.alias(self.name)), order=order, keys=(), steps=(), origin=None, variables={})

    def _rows(self, of) -> Series:
        frame = of(self.frame.assign(**{self.name: self}), F.col(f"`{self.name}`"))
        return frame.series(self.name)

    def materialize(self, table: str | None = None) -> Series:
        return self.to_frame().materialize(table=table).series(self.name)

    def reset_index(self, drop: bool = False):
        out = self.to_frame().reset_index(drop)
        return out.series(self.name) if drop else out

    def to_pandas(self, limit: int | None = None):
        return self.to_frame().to_pandas(limit)[self.name]

    def head(self, n: int = 5):
        return self.to_pandas(n)

    @property
    def value(self):
        """The one value of a single series."""
        rows = self.to_frame().to_spark().select(F.col(f"`{self.name}`")).take(2)
        if len(rows) != 1:
            raise ValueError("the series isn't one value")
        return rows[0][0]

    @property
    def array(self):
        return self.to_pandas().array

    def to_numpy(self):
        return self.to_pandas().to_numpy()

    def view_sql(self, name: str) -> str:
        return self.to_frame().view_sql(name)

    def append(self, *others: Series) -> Series:
        """The values of all, one after the other, under this name and without an index."""
        frames = [s.to_frame().reset_index(True).rename({s.name: self.name} if s.name != self.name else {}) for s in (self, *others)]
        return frames[0].append(*frames[1:]).series(self.name)

    def drop_duplicates(self, keep: str | bool = "first") -> Series:
        return self.to_frame().drop_duplicates([self.name], keep).series(self.name)

    def unstack(self, values: list | None = None, **options) -> Frame:
        return self.to_frame().unstack(values, **options)

    def get_dummies(self, **options) -> Frame:
        return self.to_frame().get_dummies(self.name, **options)

    def sort_values(self, ascending: bool = True) -> Series:
        return self._rows(lambda f, c: f.sort_values(self.name, ascending))

    def sort_by_series(self, by: list[Series], ascending: bool | list[bool] = True) -> Series:
        names = {f"__by_{i}": s.column for i, s in enumerate(by)}
        return self._rows(lambda f, c: f.assign(**names).sort_values(list(names), ascending))

    def sort_index(self, ascending: bool = True) -> Series:
        return self._rows(lambda f, c: f.sort_index(ascending))

    def __getitem__(self, key):
        """A slice of rows, the rows of a condition, or the value at a label of the index."""
        if isinstance(key, (slice, Column, Series)):
            return self._rows(lambda f, c: f[key])
        return replace(self.to_frame().loc[key].series(self.name), single=True)

    # Subqueries

    def isin(self, other: Series | list) -> Series:
        """Whether the value is among those of another series; null where that isn't known."""
        if not isinstance(other, Series):
            return self._new(self.column.isin(list(other)))
        return self.frame_where_in(other)

    def frame_where_in(self, other: Series) -> Series:
        """A column of whether there is such a value: a left join with the distinct values."""
        hidden = f"__in_{uuid.uuid4().hex[:8]}"
        found = other.attached().select(other.column.alias(hidden)).where(F.col(hidden).isNotNull()).distinct()
        return replace(self, column=F.col(hidden).isNotNull(), attach=(*self.attach, lambda df: df.join(found, self.column == F.col(hidden), "left")))

    def exists(self) -> Series:
        """One value: whether there are any rows."""
        one = self.frame.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("exists"))
        return Series(_frame(self.frame, one), F.col("exists"), "exists", True)

    def any_value(self) -> Subquery:
        return Subquery(self, True)

    def all_values(self) -> Subquery:
        return Subquery(self, False)

    def as_independent_subquery(self) -> Series:
        """This series as one value beside other frames."""
        return replace(self.to_frame().reset_index(True).series(self.name), single=True)

    # Aggregates: one value, or one for each group of the frame

    def agg(self, func, **options):
        funcs = func if isinstance(func, list) else [func]
        frame = self.frame.assign(**{self.name: self}).agg({self.name: funcs}, **options)
        if isinstance(func, list):
            return frame
        return Series(frame, F.col(f"`{frame.data[0]}`"), frame.data[0], not self.frame.keys)

    aggregate = agg

    def _agg(self, func: str, skipna: bool = True, min_count: int | None = None) -> Series:
        if not skipna:
            raise ValueError("nulls are always skipped")
        if func in grouping.NUMERIC and not grouping.is_number(self.dtype):
            raise TypeError(f"{func} of {self.dtype}")
        if func in ("min", "max") and self.dtype == "variant":
            raise TypeError("JSON has no order")
        if min_count is None:
            return self.agg(func)
        both = self.frame.assign(**{self.name: self}).agg({self.name: [func, "count"]})
        name = f"{self.name}_{func}"
        return Series(both, F.when(F.col(f"`{self.name}_count`") >= min_count, F.col(f"`{name}`")), name, not self.frame.keys)

    def count(self, **options) -> Series:
        return self._agg("count", **options)

    def min(self, **options) -> Series:
        """Of truth values: whether all are true."""
        return self._agg("all" if self.dtype == "boolean" else "min", **options)

    def max(self, **options) -> Series:
        """Of truth values: whether any is true."""
        return self._agg("any" if self.dtype == "boolean" else "max", **options)

    def sum(self, **options) -> Series:
        return self._agg("sum", **options)

    def mean(self, **options) -> Series:
        return self._agg("mean", **options)

    def median(self, **options) -> Series:
        return self._agg("median", **options)

    def mode(self, **options) -> Series:
        return self._agg("mode", **options)

    def nunique(self, **options) -> Series:
        return self._agg("nunique", **options)

    def std(self, **options) -> Series:
        return self._agg("std", **options)

    def std_pop(self, **options) -> Series:
        return self._agg("std_pop", **options)

    def var(self, **options) -> Series:
        return self._agg("var", **options)

    def sem(self, **options) -> Series:
        return self._agg("sem", **options)

    def quantile(self, q: float | list[float] = 0.5) -> Series:
        """Interpolated quantiles of numbers, or of time spans by their microseconds."""
        span = self.dtype.startswith("interval")
        column = self._new(temporal.total_microseconds(self.column).cast("double")) if span else self
        frame = self.frame.assign(**{self.name: column}).quantile([self.name], q)
        out = F.col(f"`{self.name}`")
        return Series(frame, temporal.from_microseconds(out) if span else out, self.name, not self.frame.keys and not isinstance(q, list))

    def unique(self) -> Series:
        """The distinct values, nulls among them."""
        return self.to_frame().reset_index(True).distinct().series(self.name)

    def value_counts(self, normalize: bool = False) -> Frame:
        return self.to_frame().reset_index(True).value_counts([self.name], normalize)

    def describe(self, percentiles: list[float] | None = None) -> Frame:
        if not grouping.is_number(self.dtype):
            frame = self.to_frame().reset_index(True)
            return frame.agg({self.name: ["count", "min", "max", "nunique", "mode"]})
        return self.to_frame().reset_index(True).describe(percentiles)

    # Windows: over the frame's groups, in its order

    def over(self, column: Column, ordered: bool = True) -> Series:
        order = self.frame.order
        if ordered and not order:
            raise ValueError("a window function needs sorted rows: use sort_values first")
        return self._new(column.over(windows.window(list(self.frame.keys), [c for c, _ in order], [up for _, up in order])))

    def window_row_number(self) -> Series:
        return self.over(F.row_number())

    def window_rank(self) -> Series:
        return self.over(F.rank())

    def window_dense_rank(self) -> Series:
        return self.over(F.dense_rank())

    def window_percent_rank(self) -> Series:
        return self.over(F.percent_rank())

    def window_cume_dist(self) -> Series:
        return self.over(F.cume_dist())

    def window_ntile(self, n: int) -> Series:
        return self.over(F.ntile(n))

    def window_lag(self, offset: int = 1, default=None) -> Series:
        return self.over(F.lag(self.column, offset, default))

    def window_lead(self, offset: int = 1, default=None) -> Series:
        return self.over(F.lead(self.column, offset, default))

    def window_first_value(self) -> Series:
        return self.over(F.first(self.column))

    def window_last_value(self) -> Series:
        return self.over(F.last(self.column))

    def window_nth_value(self, n: int) -> Series:
        return self.over(F.nth_value(self.column, n))

    # Bins and scales

    def cut(self, bins: int, right: bool = True) -> Series:
        return self.to_frame().cut(self.name, bins, right).series("range")

    def qcut(self, q) -> Series:
        return self.to_frame().qcut(self.name, q).series("q_range")

    def scale(self, **options) -> Series:
        return self.to_frame().scale([self.name], **options).series(self.name)

    def minmax_scale(self, feature_range: tuple[float, float] = (0, 1)) -> Series:
        return self.to_frame().minmax_scale([self.name], feature_range).series(self.name)

    # Accessors

    @property
    def str(self) -> Text:
        return Text(self)

    @property
    def dt(self) -> Time:
        return Time(self)

    @property
    def json(self) -> Json:
        return Json(self)

    @property
    def elements(self) -> Elements:
        return Elements(self)

    @classmethod
    def random(cls, frame: Frame, seed: int | None = None) -> Series:
        return cls(frame, F.rand() if seed is None else F.rand(seed), "random")

    @classmethod
    def random_uuid(cls, frame: Frame) -> Series:
        """A new one whenever it is computed: write it to a table before it is read twice."""
        return cls(frame, F.uuid(), "uuid")


def attach_all(df: DataFrame, attach: tuple) -> DataFrame:
    for put in attach:
        df = put(df)
    return df


def _literal(value) -> Column:
    if isinstance(value, Series):
        return value.column
    if isinstance(value, Column):
        return value
    if isinstance(value, dict):
        return F.struct(*[_literal(v).alias(k) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        return F.array(*[_literal(v) for v in value])
    if isinstance(value, uuid.UUID):
        return F.lit(str(value))
    return F.lit(value)


def _frame(like: Frame, df) -> Frame:
    return replace(like, df=df, index=(), keys=(), order=(), steps=(), source=None, origin=None, variables={})


class Subquery:
    """Comparison with some or with all of a series' values, as SQL has it: true, false or null."""

    def __init__(self, series: Series, some: bool):
        self.series, self.some = series, some

    def _judge(self, op: str, left: Series) -> Series:
        x = self.series.column
        row = self.series.attached().agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"), F.count(F.lit(1)).alias("all"))  # one row
        hidden = f"__sub_{uuid.uuid4().hex[:8]}"
        row = row.select(F.struct("lo", "hi", "n", "all").alias(hidden))
        s, c = F.col(hidden), left.column
        edge = {("<", True): "hi", ("<=", True): "hi", (">", True): "lo", (">=", True): "lo", ("<", False): "lo", ("<=", False): "lo", (">", False): "hi", (">=", False): "hi"}
        if op in ("=", "<>"):
            if (op == "=") == self.some:
                raise ValueError("use isin for = ANY and ~isin for <> ALL")
            # <> some value: unless all are this one; = every value: if all are this one.
            same = (s["lo"] == c) & (s["hi"] == c)
            known = ~same if op == "<>" else same
        else:
            known = _compared(op, c, s[edge[op, self.some]])
        unknown = F.lit(None).cast("boolean")
        if self.some:
            out = F.when(s["all"] == 0, F.lit(False)).when(known, F.lit(True)).when(c.isNull() | (s["n"] < s["all"]), unknown).otherwise(F.lit(False))
        else:
            out = F.when(s["all"] == 0, F.lit(True)).when(~known, F.lit(False)).when(c.isNull() | (s["n"] < s["all"]), unknown).otherwise(F.lit(True))
        return replace(left, column=out, attach=(*left.attach, lambda df: df.crossJoin(F.broadcast(row))))

    def compare(self, left: Series, op: str) -> Series:
        return self._judge(op, left)


def _compared(op: str, a: Column, b: Column) -> Column:
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


class Text:
    def __init__(self, series: Series):
        self.series = series

    def __getitem__(self, key: int | slice) -> Series:
        if isinstance(key, slice):
            return self.slice(key.start, key.stop)
        return self.slice(key, key + 1 if key != -1 else None)

    def slice(self, start: int | None = None, stop: int | None = None) -> Series:
        return self.series._new(scalars.str_slice(self.series.column, start, stop))

    def replace(self, pat: str, repl: str) -> Series:
        return self.series._new(scalars.str_replace(self.series.column, pat, repl))


class Time:
    """Dates, times, timestamps and time spans."""

    def __init__(self, series: Series):
        self.series = series

    def strftime(self, fmt: str) -> Series:
        return self.series._new(temporal.strftime(self.series.column, fmt))

    def sql_format(self, pattern: str) -> Series:
        """Spark's own patterns."""
        return self.series._new(F.date_format(self.series.column, pattern))

    def date_trunc(self, part: str) -> Series:
        return self.series._new(temporal.date_trunc(part, self.series.column))

    @property
    def components(self) -> Frame:
        return self.series.frame.assign(**temporal.components(self.series.column))[list(temporal.components(F.lit(None)))]

    @property
    def days(self) -> Series:
        return self.series._new(temporal.components(self.series.column)["days"])

    @property
    def seconds(self) -> Series:
        return self.series._new(temporal.seconds(self.series.column))

    @property
    def microseconds(self) -> Series:
        return self.series._new(temporal.microseconds(self.series.column))

    @property
    def total_seconds(self) -> Series:
        return self.series._new(temporal.total_seconds(self.series.column))


class Json:
    """JSON held as text."""

    def __init__(self, series: Series):
        self.series = series

    def __getitem__(self, key: int | str | slice) -> Series:
        if isinstance(key, slice):
            return self.series._new(scalars.json_slice(self.series.column, key.start, key.stop))
        return self.get_value(key)

    def get_value(self, key: int | str, as_str: bool = False) -> Series:
        return self.series._new(scalars.json_value(self.series.column, key, as_str))

    def get_array_length(self) -> Series:
        return self.series._new(scalars.json_length(self.series.column))

    def array_contains(self, item) -> Series:
        return self.series._new(scalars.json_contains(self.series.column, item))

    def flatten_array(self) -> tuple[Series, Series]:
        """A row for each item, by the frame's index: the items, and their places from 0. Empty and null arrays have none."""
        s = self.series
        name = f"{s.name}_offset"
        index = [F.col(f"`{c}`") for c in s.frame.index]
        df = s.attached().select(*index, F.posexplode(scalars.json_items(s.column)).alias(name, "__item"))
        df = df.select(*index, F.to_json("__item").alias(s.name), F.col(name).cast("long").alias(name))
        frame = replace(_frame(s.frame, df), index=s.frame.index)
        return frame.series(s.name), frame.series(name)


class Elements:
    """Arrays and structs."""

    def __init__(self, series: Series):
        self.series = series

    def __getitem__(self, key: int | str | slice) -> Series:
        c = self.series.column
        if isinstance(key, str):
            return self.series._new(c.getField(key), key)
        if isinstance(key, slice):
            n = F.size(c)
            low = F.lit(0) if key.start is None else (F.lit(key.start) if key.start >= 0 else F.greatest(F.lit(0), n + key.start))
            high = n if key.stop is None else (F.least(F.lit(key.stop), n) if key.stop >= 0 else n + key.stop)
            return self.series._new(F.slice(c, low + 1, F.greatest(F.lit(0), high - low)))
        return self.series._new(F.get(c, F.lit(key) if key >= 0 else F.size(c) + key))

    def len(self) -> Series:
        return self.series._new(F.size(self.series.column).cast("long"))

    def flatten(self) -> Frame:
        """A column for each field of a struct, nulls where it is null."""
        fields = self.series.attached().select(self.series.column.alias("x")).schema[0].dataType.names
        index = [F.col(f"`{c}`") for c in self.series.frame.index]
        df = self.series.attached().select(*index, *[self.series.column.getField(c).alias(c) for c in fields])
        return replace(_frame(self.series.frame, df), index=self.series.frame.index)
