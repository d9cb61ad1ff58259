"""Aggregation: the functions by name, grouped frames, cube, rollup and grouping sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Agg = Callable[[Column], Column]


def sem(c: Column) -> Column:
    return F.stddev_samp(c) / F.sqrt(F.count(c))


#: Aggregates by name; nulls are skipped by all of them.
FUNCTIONS: dict[str, Agg] = {
    "count": F.count, "min": F.min, "max": F.max, "sum": F.sum, "mean": F.avg, "nunique": F.count_distinct,
    "std": F.stddev_samp, "std_pop": F.stddev_pop, "var": F.var_samp, "sem": sem, "any": F.bool_or, "all": F.bool_and,
    "list": F.collect_list,
}
#: Those that take numbers (or intervals) only, and those that go by how often each value occurs.
NUMERIC = {"sum", "mean", "std", "std_pop", "var", "sem"}
COUNTED = ("median", "mode")
#: The square of this many ranges of values are told apart, in two steps.
SIDE = 16


def is_number(kind: str) -> bool:
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith(("decimal", "interval"))


def resolve(func: str | Agg) -> tuple[str, Agg]:
    if callable(func):
        return getattr(func, "__name__", "agg"), func
    if func in COUNTED:
        return func, FUNCTIONS["count"]
    if func not in FUNCTIONS:
        raise ValueError(f"unknown aggregate {func}")
    return func, FUNCTIONS[func]


def at_least(agg: Column, c: Column, min_count: int) -> Column:
    """An aggregate that is null unless so many values aren't."""
    return F.when(F.count(c) >= min_count, agg)


def check_quantiles(qs: list[float]) -> list[float]:
    for x in qs:
        if not 0 <= x <= 1:
            raise ValueError("quantiles lie between 0 and 1")
    return qs


def expressions(spec: dict[str, str | Agg | list]) -> list[Column]:
    """<column>_<function> for each entry of {column: function or functions}."""
    out, names = [], set()
    for column, funcs in spec.items():
        for func in funcs if isinstance(funcs, list) else [funcs]:
            name, f = resolve(func)
            alias = f"{column}_{name}"
            if alias in names:
                raise ValueError(f"two aggregates are named {alias}")
            names.add(alias)
            out.append(f(F.col(f"`{column}`")).alias(alias))
    return out


def _each(df: DataFrame, by: list[str], value: Column) -> tuple[list[str], DataFrame]:
    """The names of the keys, and how often each value that isn't null occurs in each group (__k0.., __v, __n)."""
    names = [f"__k{i}" for i in range(len(by))]
    values = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(by, names, strict=True)], value.alias("__v")).where("__v IS NOT NULL")
    return names, values.groupBy(*names, "__v").agg(F.count(F.lit(1)).alias("__n"))


def same_keys(names: list[str], others: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(names, others, strict=True):
        out = out & F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))
    return out


def _place(c: Column, kind: str) -> Column:
    """A number that never falls as a value rises; text goes by its first bytes, types without one are all in one place."""
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("double")
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind == "timestamp":
        return F.unix_micros(c).cast("double")
    if kind == "timestamp_ntz":
        return (F.unix_date(F.to_date(c)).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)).cast("double")
    return c.cast("double") if kind == "boolean" or is_number(kind) and not kind.startswith("interval") else F.lit(0.0)


def at_ranks(df: DataFrame, by: list[str], value: Column, ranks: Callable[[Column], Column]) -> DataFrame:
    """(__k0.., __i, __x, __t): the values at some ranks (from 1) of each group, given by its number of rows, and that number.

    Rows are summed up by value, and values by SIDE^2 ranges of about as many rows each; a rank's
    range is found from those sums, so that only values of such ranges are sorted. A group is
    spread over tasks, and no buffer holds its values.
    """
    names, each = _each(df, by, value)
    place = _place(F.col("__v"), dict(each.dtypes)["__v"])
    steps = [k / SIDE**2 for k in range(1, SIDE**2)]
    bounds = df.select(value.alias("__v")).agg(F.percentile_approx(place, steps, 10 * SIDE**2).alias("__bounds"))  # one row, no shuffle of values
    bounds = bounds.withColumn("__coarse", F.transform(F.sequence(F.lit(SIDE), F.lit(SIDE**2 - 1), F.lit(SIDE)), lambda k: F.get("__bounds", k - 1)))
    below = lambda xs: F.size(F.filter(xs, lambda x: x < F.col("__p")))
    each = each.withColumn("__p", place).crossJoin(F.broadcast(bounds)).withColumn("__c", below(F.col("__coarse")))
    fine = below(F.slice("__bounds", F.col("__c") * SIDE + 1, F.lit(SIDE - 1)))
    each = each.withColumn("__b", F.col("__c") * SIDE + fine).drop("__bounds", "__coarse", "__p", "__c")
    sums = each.groupBy(*names, "__b").agg(F.sum("__n").alias("__s"))  # at most SIDE^2 rows a group
    whole = Window.partitionBy(*names)
    sums = sums.withColumn("__t", F.sum("__s").over(whole)).withColumn("__upto", F.sum("__s").over(whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    wanted = F.transform(ranks(F.col("__t")), lambda r, i: F.struct(i.alias("i"), r.alias("r")))
    here = F.filter(wanted, lambda x: (x["r"] > F.col("__upto") - F.col("__s")) & (x["r"] <= F.col("__upto")))
    found = sums.select(*[F.col(n).alias(f"{n}_") for n in names], F.col("__b").alias("__b_"), (F.col("__upto") - F.col("__s")).alias("__before"), "__t", here.alias("__here")).where(F.size("__here") > 0)
    near = each.join(found, same_keys([*names, "__b"], [f"{n}_" for n in [*names, "__b"]]))
    upto = F.sum("__n").over(Window.partitionBy(*names, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = near.withColumn("__u", upto + F.col("__before"))
    mine = F.filter("__here", lambda x: (x["r"] > F.col("__u") - F.col("__n")) & (x["r"] <= F.col("__u")))
    out = near.select(*names, F.col("__v").alias("__x"), "__t", mine.alias("__mine")).where(F.size("__mine") > 0)
    return out.select(*names, F.explode("__mine.i").alias("__i"), "__x", "__t")


def quantiles(df: DataFrame, by: list[str], column: str, qs: list[float], alias: str) -> DataFrame:
    """(__k0.., alias): interpolated quantiles of each group with values, as an array; without groups one row, of nulls if there are no values."""
    position = lambda t, q: F.lit(float(q)) * (t - 1)
    ends = lambda t: F.array(*[f(position(t, q)).cast("long") + 1 for q in check_quantiles(qs) for f in (F.floor, F.ceil)])
    names = [f"__k{i}" for i in range(len(by))]
    found = at_ranks(df, by, F.col(f"`{column}`").cast("double"), ends)
    found = found.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("__i", "__x"))).alias("__m"), F.max("__t").alias("__t"))
    at = lambda k: F.try_element_at("__m", F.lit(k))
    between = [at(2 * k) + (at(2 * k + 1) - at(2 * k)) * (position(F.col("__t"), q) - F.floor(position(F.col("__t"), q))) for k, q in enumerate(qs)]
    # Equal ends are taken as they are: infinite ones have no difference.
    return found.select(*names, F.array(*[F.when(at(2 * k) == at(2 * k + 1), at(2 * k)).otherwise(x) for k, x in enumerate(between)]).alias(alias))


def quantiles_by(df: DataFrame, by: list[str], columns: list[str], qs: list[float]) -> DataFrame:
    """The groups, and an array of quantiles for each column."""
    names = [f"__k{i}" for i in range(len(by))]
    out = df.select(*[F.col(f"`{c}`") for c in by]).distinct() if by else None
    for c in columns:
        found = quantiles(df, by, c, qs, c if not by else f"__q_{c}")
        if by:
            out = out.join(found, same_keys(by, names), "left").drop(*names)
        else:
            out = found if out is None else out.crossJoin(F.broadcast(found))
    return out.select(*[F.col(f"`{c}`") for c in by], *[F.col(f"`__q_{c}`" if by else f"`{c}`").alias(c) for c in columns])


def _counted(df: DataFrame, by: list[str], column: str, name: str, alias: str) -> DataFrame:
    """The discrete median or the mode (the smallest of several) of any ordered type, from how often each value occurs."""
    if name == "median":
        names = [f"__k{i}" for i in range(len(by))]
        return at_ranks(df, by, F.col(f"`{column}`"), lambda t: F.array(F.floor((t + 1) / 2).cast("long"))).select(*names, F.col("__x").alias(alias))
    names, each = _each(df, by, F.col(f"`{column}`"))
    top = each.groupBy(*names).agg(F.max("__n").alias("__m"))
    top = top.select(*[F.col(c).alias(f"{c}_") for c in names], "__m")
    same = same_keys(names, [f"{c}_" for c in names])
    return each.join(F.broadcast(top) if not by else top, same & (F.col("__n") == F.col("__m"))).groupBy(*names).agg(F.min("__v").alias(alias))


def aggregate_by(df: DataFrame, by: list[str], spec: dict[str, str | Agg | list]) -> DataFrame:
    """<column>_<function> for each entry, by group; medians and modes are joined to the others by the keys."""
    exprs = expressions(spec)  # also checks names
    pairs = [(c, f) for c, funcs in spec.items() for f in (funcs if isinstance(funcs, list) else [funcs])]
    plain = [e for e, (_, f) in zip(exprs, pairs, strict=True) if f not in COUNTED]
    if len(plain) == len(pairs):
        return aggregate(df, [F.col(f"`{c}`") for c in by], *plain)
    out = aggregate(df, [F.col(f"`{c}`") for c in by], *(plain or [F.count(F.lit(1)).alias("__rows")]))
    for c, f in pairs:
        if f in COUNTED:
            found = _counted(df, by, c, f, f"{c}_{f}")
            names = [f"__k{i}" for i in range(len(by))]
            out = out.join(found, same_keys(by, names), "left").drop(*names)
    return out.select(*[F.col(f"`{c}`") for c in by], *[F.col(f"`{c}_{f if isinstance(f, str) else getattr(f, '__name__', 'agg')}`") for c, f in pairs])


def aggregate(df: DataFrame, by: list, *exprs: Column) -> DataFrame:
    return df.groupBy(*by).agg(*exprs) if by else df.agg(*exprs)


def grouping_sets(df: DataFrame, sets: list[list[str]], *exprs: Column) -> DataFrame:
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*exprs)


def value_counts(df: DataFrame, subset: list[str], normalize: bool = False) -> DataFrame:
    """Rows per combination of values. The normalised form reads the total from the counts, not from the rows."""
    out = df.groupBy(*subset).agg(F.count(F.lit(1)).alias("value_counts"))
    if normalize:
        total = out.agg(F.sum("value_counts").alias("_total"))  # one row
        out = out.crossJoin(F.broadcast(total)).withColumn("value_counts", F.col("value_counts") / F.col("_total")).drop("_total")
    return out


def describe(df: DataFrame, columns: list[str], percentiles: list[float] | None = None) -> DataFrame:
    """count, mean, std, min, max, nunique, mode and percentiles of numeric columns, a row each in __stat."""
    percentiles = [0.25, 0.5, 0.75] if percentiles is None else percentiles
    stats = ["count", "mean", "std", "min", "max", "nunique"]
    one = df.agg(*[F.array(*[FUNCTIONS[s](F.col(f"`{c}`")).cast("double") for s in stats]).alias(f"__s_{c}") for c in columns])
    for c in columns:
        mode = _counted(df, [], c, "mode", f"__m_{c}").select(F.array(F.col(f"`__m_{c}`").cast("double")).alias(f"__m_{c}"))
        one = one.crossJoin(F.broadcast(mode)).crossJoin(F.broadcast(quantiles(df, [], c, percentiles, f"__p_{c}")))  # one row each
    every = {c: F.transform(F.concat(*[F.col(f"`__{k}_{c}`") for k in "smp"]), lambda x: F.round(x, 2)).alias(c) for c in columns}
    names = [*stats, "mode", *[str(p) for p in percentiles]]
    at = one.select(*every.values(), F.posexplode(F.array(*[F.lit(n) for n in names])).alias("_at", "__stat"))
    return at.orderBy("_at").select("__stat", *[F.get(F.col(f"`{c}`"), F.col("_at")).alias(c) for c in columns])
