"""A lazy, pandas-like frame over a Spark DataFrame: immutable, with index columns and an order that is applied last."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import grouping, joining, shaping, windows
from .series import Series
from .series import attach_all as attached

#: Columns that hold a frame's variables begin so; they are never part of a result.
VARIABLE = "__variable__"


def step(method: Callable) -> Callable:
    """A method that gives a frame is recorded there, so that it can be done again on other rows or with other variables."""

    @wraps(method)
    def done(self, *args, **options):
        out = method(self, *args, **options)
        if not isinstance(out, Frame):
            return out
        out = replace(out, steps=(*self.steps, (method.__name__, args, options)), source=self.source, origin=self.origin or self)
        return out._filled(self.variables | out.variables)

    return done


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    index: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    variables: dict = field(default_factory=dict)
    #: The frame before sampling, the first frame of this chain, and what was done since.
    source: Frame | None = None
    origin: Frame | None = None
    steps: tuple = ()
    savepoints: dict = field(default_factory=dict)

    # Sources and sinks

    @classmethod
    def from_table(cls, spark: SparkSession, name: str, index: list[str] | None = None) -> Frame:
        return cls(spark.table(name), tuple(index or ()))

    @classmethod
    def from_model(cls, spark: SparkSession, sql: str, index: list[str] | None = None, args: dict | None = None) -> Frame:
        return cls(spark.sql(sql, args=args), tuple(index or ()))

    @classmethod
    def from_pandas(cls, spark: SparkSession, pdf) -> Frame:
        from .sources.tables import from_pandas

        df = from_pandas(spark, pdf)
        return cls(df, tuple(c for c in df.columns if c.startswith("_index_")))

    def to_spark(self) -> DataFrame:
        df = self.df
        if self.order:
            df = df.orderBy(*windows.ordered([c for c, _ in self.order], [up for _, up in self.order]))
        return df.drop(*[c for c in df.columns if c.startswith(VARIABLE)])

    def to_pandas(self, limit: int | None = None):
        df = self.to_spark()
        out = (df.limit(limit) if limit is not None else df).toPandas()
        return out.set_index(list(self.index)) if self.index else out

    def head(self, n: int = 5):
        return self.to_pandas(n)

    def to_numpy(self):
        return self.to_pandas().to_numpy()

    def to_table(self, name: str, if_exists: str = "fail") -> Frame:
        """A new starting point that reads a table which is written now."""
        from .sources.tables import to_table

        out = replace(self, df=to_table(self.to_spark(), name, if_exists), order=(), steps=(("to_table", (name, if_exists), {}),), origin=None)
        return out._filled(self.variables)

    def plan(self) -> str:
        """The optimised plan as text."""
        return self.to_spark()._jdf.queryExecution().optimizedPlan().toString()

    def view_sql(self, name: str) -> str:
        """SQL text that gives these rows in this session: the frame becomes a temporary view of that name."""
        self.to_spark().createOrReplaceTempView(name)
        order = ", ".join(f"`{c}` {'ASC' if up else 'DESC'} NULLS LAST" for c, up in self.order)
        return f"SELECT * FROM `{name}`" + (f" ORDER BY {order}" if order else "")

    def dtypes(self) -> dict[str, str]:
        """Types of the columns that aren't the index."""
        return {c: t for c, t in self.df.dtypes if c in self.data}

    # Columns and rows

    def _with(self, df: DataFrame, **changes) -> Frame:
        return replace(self, df=df, **changes)

    def _filled(self, variables: dict) -> Frame:
        """The frame with a column for each variable."""
        missing = {f"{VARIABLE}{k}": F.lit(v) for k, v in variables.items() if f"{VARIABLE}{k}" not in self.df.columns}
        return replace(self, df=self.df.withColumns(missing), variables=variables) if missing else replace(self, variables=variables)

    def again(self, start: Frame) -> Frame:
        """What was done to this frame, done to another one."""
        for name, args, options in self.steps:
            if name == "to_table":
                raise ValueError(f"the table {args[0]} was written on the way, which isn't done again")
            start = getattr(start, name)(*args, **options)
        return start

    @property
    def data(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.index and not c.startswith(VARIABLE)]

    def __getattr__(self, name: str) -> Series:
        if name.startswith("_") or name not in self.df.columns:
            raise AttributeError(name)
        return self.series(name)

    def series(self, name: str) -> Series:
        return Series(self, self._column(name), name)

    @property
    def loc(self) -> Loc:
        return Loc(self)

    def _column(self, key: str) -> Column:
        if key not in self.df.columns:
            raise KeyError(key)
        return F.col(f"`{key}`")

    @step
    def __getitem__(self, key):
        """A column, some columns, a slice of rows, or the rows of a condition; the order stays."""
        if isinstance(key, str):
            return self._column(key)
        if isinstance(key, slice):
            if key.step is not None or (key.start or 0) < 0 or (key.stop or 0) < 0:
                raise ValueError("slices have no step and no negative bounds")
            df = self.to_spark().offset(key.start or 0)
            return self._with(df if key.stop is None else df.limit(max(0, key.stop - (key.start or 0))))
        if isinstance(key, Series):
            attach, condition = key.beside(self)
            out = attached(self.df, attach).where(condition)
            return self._with(out.drop(*[c for c in out.columns if c not in self.df.columns]))
        if isinstance(key, Column):
            return self._with(self.df.where(key))
        for c in key:
            self._column(c)
        return self._with(self.df.select(*[F.col(f"`{c}`") for c in (*self.index, *[c for c in key if c not in self.index])]))

    @step
    def assign(self, **columns) -> Frame:
        """Columns by name: constants, columns, functions of the frame, or series; a series of another frame is one value, or is joined on the index."""
        out = self
        for k, v in columns.items():
            v = v(out) if callable(v) and not isinstance(v, (Column, Series)) else v
            if isinstance(v, Series):
                attach, column = v.beside(self)
                df = attached(out.df, attach).withColumn(k, column)
                out = out._with(df.drop(*[c for c in df.columns if c not in out.df.columns and c != k]))
            else:
                out = out._with(out.df.withColumn(k, v if isinstance(v, Column) else F.lit(v)))
        return out

    @step
    def where_set(self, condition: Column, column: str, value) -> Frame:
        """Set a column where a condition holds."""
        return self.assign(**{column: F.when(condition, value).otherwise(self._column(column))})

    @step
    def drop(self, columns: list[str], errors: str = "raise") -> Frame:
        missing = [c for c in columns if c not in self.df.columns]
        if missing and errors == "raise":
            raise KeyError(missing)
        return self._with(self.df.drop(*columns))

    @step
    def rename(self, names: dict[str, str]) -> Frame:
        out = [names.get(c, c) for c in self.df.columns]
        if len(set(out)) < len(out):
            raise ValueError("names would repeat")
        return self._with(self.df.withColumnsRenamed(names), index=tuple(names.get(c, c) for c in self.index), order=tuple((names.get(c, c), up) for c, up in self.order))

    @step
    def set_index(self, keys: list[str], append: bool = False) -> Frame:
        return replace(self, index=(self.index if append else ()) + tuple(keys))

    @step
    def reset_index(self, drop: bool = False) -> Frame:
        return self._with(self.df.drop(*self.index) if drop else self.df, index=())

    @step
    def astype(self, dtype: str | dict[str, str]) -> Frame:
        kinds = dtype if isinstance(dtype, dict) else dict.fromkeys(self.data, dtype)
        return self.assign(**{c: self._column(c).cast(k) for c, k in kinds.items()})

    @step
    def fillna(self, value) -> Frame:
        values = value if isinstance(value, dict) else dict.fromkeys(self.data, value)
        return self.assign(**{c: F.coalesce(self._column(c), F.lit(v)) for c, v in values.items()})

    @step
    def dropna(self, how: str = "any", thresh: int | None = None, subset: list[str] | None = None) -> Frame:
        return self._with(self.df.dropna(how, thresh, subset or self.data))

    @step
    def round(self, decimals: int = 0) -> Frame:
        """All numeric columns, half away from zero."""
        from .functions.scalars import round_half_up

        return self.assign(**{c: round_half_up(self._column(c), decimals) for c, t in self.dtypes().items() if t in ("double", "float") or t.startswith("decimal")})

    @step
    def ffill(self, by: list[str], partition: list[str] | None = None) -> Frame:
        spec = windows.window(partition or [], by)
        return self.assign(**{c: windows.ffill(self._column(c), spec) for c in self.data if c not in by})

    @step
    def bfill(self, by: list[str], partition: list[str] | None = None) -> Frame:
        spec = windows.window(partition or [], by)
        return self.assign(**{c: windows.bfill(self._column(c), spec) for c in self.data if c not in by})

    @step
    def sort_values(self, by: str | list[str], ascending: bool | list[bool] = True) -> Frame:
        by = [by] if isinstance(by, str) else by
        flags = ascending if isinstance(ascending, list) else [ascending] * len(by)
        return replace(self, order=tuple(zip(by, flags, strict=True)))

    @step
    def sort_index(self, ascending: bool = True) -> Frame:
        return self.sort_values(list(self.index), ascending)

    def materialize(self, distinct: bool = False, table: str | None = None) -> Frame:
        """A new starting point: distinct rows, or a table that is read from now on."""
        if table:
            return self._with(self.df.distinct() if distinct else self.df, order=()).to_table(table, "replace")
        return self.distinct() if distinct else self

    @step
    def distinct(self) -> Frame:
        return self._with(self.df.distinct(), order=())

    @step
    def drop_duplicates(self, subset: list[str] | None = None, keep: str | bool = "first", by: list[str] | None = None, ascending: bool = True) -> Frame:
        return self._with(windows.drop_duplicates(self.df, subset or self.data, keep, by, ascending))

    # Several frames

    @step
    def merge(self, right: Frame, how: str = "inner", on: str | list[str] | None = None, **options) -> Frame:
        on = [on] if isinstance(on, str) else on
        return self._with(joining.merge(self.to_spark(), right.to_spark(), how, on, **options), order=(), keys=(), index=(), variables=right.variables | self.variables)

    @step
    def append(self, *others: Frame) -> Frame:
        return self._with(joining.append([self.to_spark(), *[o.to_spark() for o in others]]), order=())

    @step
    def isin(self, column: str, other: Frame) -> Frame:
        return self._with(joining.isin(self.df, column, other.df))

    # Groups

    @step
    def groupby(self, by: str | list[str] | None = None) -> Frame:
        return replace(self, keys=tuple([by] if isinstance(by, str) else by or ()))

    @step
    def agg(self, spec: dict) -> Frame:
        """<column>_<function>; the group keys become the index."""
        out = grouping.aggregate_by(self.df, list(self.keys), spec)
        return self._with(out, index=self.keys, keys=(), order=())

    aggregate = agg

    def _all(self, func: str, skipna: bool = True, numeric_only: bool = False, min_count: int | None = None) -> Frame:
        if not skipna:
            raise ValueError("nulls are always skipped")
        picks = [c for c in self.data if c not in self.keys]
        numbers = [c for c, t in self.df.dtypes if grouping.is_number(t)]
        if func in grouping.NUMERIC and not numeric_only and (other := [c for c in picks if c not in numbers]):
            raise ValueError(f"{func} takes numbers only: {other}; or numeric_only=True")
        out = self.agg({c: func for c in picks if c in numbers or not numeric_only})
        if min_count is None:
            return out
        full = grouping.aggregate(self.df, list(self.keys), *[F.count(F.col(f"`{c}`")).alias(f"{c}_{func}") for c in picks])
        return out.having_count(full, min_count)

    def having_count(self, counts: DataFrame, least: int) -> Frame:
        """Values whose counts, in a frame of the same index and columns, are too low become null."""
        names = {c: f"__n_{c}" for c in counts.columns}
        both = self.df.join(counts.withColumnsRenamed(names), [F.col(f"`{c}`").eqNullSafe(F.col(f"`{names[c]}`")) for c in self.index] or F.lit(True))
        return self._with(both.select(*[F.col(f"`{c}`") for c in self.index], *[F.when(F.col(f"`{names[c]}`") >= least, F.col(f"`{c}`")).alias(c) for c in self.data if c in names]))

    @step
    def count(self, **options) -> Frame:
        return self._all("count", **options)

    @step
    def min(self, **options) -> Frame:
        return self._all("min", **options)

    @step
    def max(self, **options) -> Frame:
        return self._all("max", **options)

    @step
    def sum(self, **options) -> Frame:
        return self._all("sum", **options)

    @step
    def mean(self, **options) -> Frame:
        return self._all("mean", **options)

    @step
    def median(self, **options) -> Frame:
        return self._all("median", **options)

    @step
    def mode(self, **options) -> Frame:
        return self._all("mode", **options)

    @step
    def nunique(self, **options) -> Frame:
        return self._all("nunique", **options)

    @step
    def std(self, **options) -> Frame:
        return self._all("std", **options)

    @step
    def std_pop(self, **options) -> Frame:
        return self._all("std_pop", **options)

    @step
    def var(self, **options) -> Frame:
        return self._all("var", **options)

    @step
    def sem(self, **options) -> Frame:
        return self._all("sem", **options)

    @step
    def having(self, spec: dict, condition: Column) -> Frame:
        out = self.agg(spec)
        return out._with(out.df.where(condition))

    @step
    def cube(self, by: list[str], spec: dict) -> Frame:
        return self._with(self.df.cube(*by).agg(*grouping.expressions(spec)), index=tuple(by), keys=(), order=())

    @step
    def rollup(self, by: list[str], spec: dict) -> Frame:
        return self._with(self.df.rollup(*by).agg(*grouping.expressions(spec)), index=tuple(by), keys=(), order=())

    @step
    def grouping_sets(self, sets: list[list[str]], spec: dict) -> Frame:
        out = grouping.grouping_sets(self.df, sets, *grouping.expressions(spec))
        return self._with(out, index=tuple(dict.fromkeys(c for s in sets for c in s)), keys=(), order=())

    @step
    def value_counts(self, subset: list[str] | None = None, normalize: bool = False) -> Frame:
        subset = list(self.keys) + (subset or self.data)
        out = grouping.value_counts(self.df, subset, normalize)
        return self._with(out, index=tuple(subset), keys=(), order=(("value_counts", False),))

    @step
    def describe(self, percentiles: list[float] | None = None) -> Frame:
        numbers = [c for c, t in self.df.dtypes if c in self.data and t in ("bigint", "int", "double", "float", "smallint")]
        return self._with(grouping.describe(self.df, numbers, percentiles), index=("__stat",), keys=(), order=())

    @step
    def quantile(self, columns: list[str], q: float | list[float] = 0.5) -> Frame:
        """Interpolated quantiles of each group; a list of them adds the index column quantile."""
        qs = q if isinstance(q, list) else [q]
        out = grouping.quantiles_by(self.df, list(self.keys), columns, grouping.check_quantiles(qs))
        at = out.select(*self.keys, *columns, F.posexplode(F.array(*[F.lit(x) for x in qs])).alias("_at", "quantile"))
        picks = [F.get(F.col(c), F.col("_at")).alias(c) for c in columns]
        index = (*self.keys, "quantile") if isinstance(q, list) else self.keys
        return self._with(at.select(*index, *picks), index=index, keys=(), order=())

    # Windows: over the group keys, in the frame's order

    def _spec(self):
        return windows.window(list(self.keys), [c for c, _ in self.order], [up for _, up in self.order])

    @step
    def over(self, **columns: Column) -> Frame:
        """Window functions over the keys and the order: name = function column."""
        spec = self._spec()
        return self._with(self.df.withColumns({k: c.over(spec) for k, c in columns.items()}))

    @step
    def rolling(self, spec: dict[str, str], window: int, min_periods: int | None = None, center: bool = False) -> Frame:
        """<column>_<function> over the last rows of each row's group."""
        made = {f"{c}_{f}": windows.rolling(grouping.resolve(f)[1](F.col(c)), self._spec(), window, min_periods, center) for c, f in spec.items()}
        return self._with(self.df.withColumns(made))

    @step
    def expanding(self, spec: dict[str, str], min_periods: int = 1) -> Frame:
        made = {f"{c}_{f}": windows.expanding(grouping.resolve(f)[1](F.col(c)), self._spec(), min_periods) for c, f in spec.items()}
        return self._with(self.df.withColumns(made))

    # Shapes

    @step
    def hist(self, columns: list[str], bins: int = 10) -> Frame:
        """Rows of each of a number of equal bins, over all columns at once: lower, upper, and a count for each column."""
        return self._with(shaping.histogram(self.df, columns, bins), index=("lower", "upper"), keys=(), order=())

    @step
    def stack(self, columns: list[str] | None = None, dropna: bool = True) -> Frame:
        return self._with(shaping.stack(self.df, list(self.index), columns or self.data, dropna), index=(*self.index, "__stacked_index"), order=())

    @step
    def unstack(self, values: list | None = None, fill_value=None, aggregation: str = "max") -> Frame:
        *rest, level = self.index
        return self._with(shaping.unstack(self.df, rest, level, self.data, values, fill_value, aggregation), index=tuple(rest), order=())

    @step
    def get_dummies(self, column: str, **options) -> Frame:
        return self._with(shaping.get_dummies(self.df, column, **options))

    @step
    def scale(self, columns: list[str], **options) -> Frame:
        return self._with(shaping.scale(self.df, columns, **options))

    @step
    def minmax_scale(self, columns: list[str], feature_range: tuple[float, float] = (0, 1)) -> Frame:
        return self._with(shaping.minmax_scale(self.df, columns, feature_range))

    @step
    def cut(self, column: str, bins: int, right: bool = True) -> Frame:
        return self._with(shaping.cut(self.df, column, bins, right))

    @step
    def qcut(self, column: str, q) -> Frame:
        return self._with(shaping.qcut(self.df, column, q))

    def fit_scaler(self, columns: list[str], kind: str = "standard", **options) -> shaping.Scaler:
        """Parameters of these rows, to scale other frames by."""
        return shaping.Scaler.fit(self.df, columns, kind, **options)

    @step
    def transform(self, scaler: shaping.Scaler) -> Frame:
        return self._with(scaler.transform(self.df))

    # Samples, variables and savepoints

    def sample(self, percentage: float, seed: int, table: str | None = None) -> Frame:
        made = replace(self, df=shaping.sample(self.df, percentage, seed), order=(), source=self, origin=None, steps=())
        return replace(made.to_table(table, "replace"), source=self, steps=()) if table else made

    def unsampled(self) -> Frame:
        """What was done to a sample, done to all rows."""
        if self.source is None:
            raise ValueError("this frame isn't a sample")
        return self.again(self.source)

    def create_variable(self, name: str, value) -> tuple[Frame, Column]:
        """The frame with a variable, and a column that stands for it, also after its value has changed."""
        out = self.set_variable(name, value)
        return out, out.variable(name)

    def set_variable(self, name: str, value) -> Frame:
        """The variable has this value in all that was made of it: the steps are done again."""
        if name not in self.variables:
            return self._filled(self.variables | {name: value})
        if type(value) is not type(self.variables[name]):
            raise ValueError(f"{name} is of type {type(self.variables[name]).__name__}")
        start = self.origin or self
        start = replace(start, df=start.df.drop(*[c for c in start.df.columns if c.startswith(VARIABLE)]), variables={})
        return self.again(start._filled(self.variables | {name: value}))

    def variable(self, name: str) -> Column:
        if name not in self.variables:
            raise KeyError(name)
        return F.col(f"{VARIABLE}{name}")

    def variable_usage(self) -> dict[str, int]:
        """How many times each variable stands in what was done."""
        text = " ".join(repr((args, options)) for _, args, options in self.steps)
        return {k: text.count(f"{VARIABLE}{k}") for k in self.variables}

    def set_savepoint(self, name: str, materialization: str = "query") -> Frame:
        """A name for the rows at this point; see savepoints.Savepoints."""
        from .savepoints import check

        check(name, materialization, self.savepoints)
        return replace(self, savepoints=self.savepoints | {name: (self, materialization)})


class Loc:
    """Rows by labels of a frame's first index column, or by a condition, and columns by name."""

    def __init__(self, frame: Frame):
        self.frame = frame

    def _condition(self, key) -> Column | Series | None:
        if isinstance(key, (Column, Series)):
            return key
        if not self.frame.index:
            raise ValueError("the frame has no index")
        label = self.frame[self.frame.index[0]]
        if isinstance(key, slice):
            if key.step is not None:
                raise ValueError("slices have no step")
            out = F.lit(True)
            out = out if key.start is None else out & (label >= F.lit(key.start))
            return out if key.stop is None else out & (label <= F.lit(key.stop))  # both ends are included
        return label.isin(list(key)) if isinstance(key, (list, tuple, set)) else label == F.lit(key)

    def __getitem__(self, key) -> Frame:
        rows, columns = key if isinstance(key, tuple) else (key, None)
        out = self.frame[self._condition(rows)]
        return out if columns is None else out[self._names(columns)]

    def _names(self, columns) -> list[str]:
        if isinstance(columns, slice):
            data = self.frame.data
            low = 0 if columns.start is None else data.index(columns.start)
            return data[low : len(data) if columns.stop is None else data.index(columns.stop) + 1]
        return [columns] if isinstance(columns, str) else list(columns)

    def set(self, rows, columns, value) -> Frame:
        """The frame with a value in those columns of those rows."""
        condition = self._condition(rows)
        for c in self._names(columns):
            if isinstance(condition, Series):
                raise ValueError("give the condition as a column")
            self.frame = self.frame.where_set(condition, c, value)
        return self.frame
