"""Merge of two frames on equal keys, arbitrary conditions, or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "cross": "cross"}


def merge(left: DataFrame, right: DataFrame, how: str = "inner", on: list[str] | None = None, left_on: list[str] | None = None, right_on: list[str] | None = None, condition=None, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Equal-named keys become one column, filled from either side; other clashes get suffixes.

    condition takes (left, right) and gives a boolean column: a theta join, beside or without keys.
    """
    if how not in HOW:
        raise ValueError(f"how is one of {list(HOW)}")
    if on and (left_on or right_on):
        raise ValueError("give on, or left_on and right_on")
    lk, rk = (on, on) if on else (left_on or [], right_on or [])
    if len(lk) != len(rk):
        raise ValueError("left_on and right_on differ in length")
    if how == "cross" and (lk or condition):
        raise ValueError("a cross merge takes no keys")
    if not lk and condition is None and how != "cross":
        lk = rk = [c for c in left.columns if c in right.columns]
        if not lk:
            raise ValueError("the frames share no column")
    a = left.select(*[F.col(f"`{c}`").alias(f"_l_{c}") for c in left.columns])
    b = right.select(*[F.col(f"`{c}`").alias(f"_r_{c}") for c in right.columns])
    cond: Column | None = None
    for x, y in zip(lk, rk, strict=True):
        one = F.col(f"`_l_{x}`") == F.col(f"`_r_{y}`")
        cond = one if cond is None else cond & one
    if condition is not None:
        extra = condition(lambda c: F.col(f"`_l_{c}`"), lambda c: F.col(f"`_r_{c}`"))
        cond = extra if cond is None else cond & extra
    joined = a.crossJoin(b) if how == "cross" else a.join(b, cond, HOW[how])
    same = {x for x, y in zip(lk, rk, strict=True) if x == y}
    out = []
    for c in left.columns:
        if c in same:
            out.append(F.coalesce(F.col(f"`_l_{c}`"), F.col(f"`_r_{c}`")).alias(c))
        else:
            out.append(F.col(f"`_l_{c}`").alias(c + suffixes[0] if c in right.columns else c))
    out += [F.col(f"`_r_{c}`").alias(c + suffixes[1] if c in left.columns else c) for c in right.columns if c not in same]
    return joined.select(*out)


def isin(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose value is among those of a one-column frame."""
    return df.join(values.select(F.col(values.columns[0]).alias("_in")).distinct(), F.col(column) == F.col("_in"), "left_semi")


def compare_any(df: DataFrame, column: str, op: str, values: DataFrame) -> DataFrame:
    """Rows with column <op> some value of a one-column frame: a comparison with its least or greatest value."""
    return _compare(df, column, op, values, True)


def compare_all(df: DataFrame, column: str, op: str, values: DataFrame) -> DataFrame:
    """Rows with column <op> every value of a one-column frame: all rows if it is empty, none if it holds a null."""
    return _compare(df, column, op, values, False)


def _compare(df: DataFrame, column: str, op: str, values: DataFrame, some: bool) -> DataFrame:
    if op not in ("<", "<=", ">", ">="):
        raise ValueError("op is an order comparison")
    c = F.col(f"`{values.columns[0]}`")
    edge = F.min(c) if (op in (">", ">=")) == some else F.max(c)
    one = values.agg(edge.alias("_edge"), F.count(c).alias("_known"), F.count(F.lit(1)).alias("_all"))  # one row
    holds = F.expr(f"`{column}` {op} _edge")
    if not some:
        holds = (F.col("_all") == 0) | ((F.col("_known") == F.col("_all")) & holds)
    return df.crossJoin(F.broadcast(one)).where(holds).drop("_edge", "_known", "_all")


NUMBERS = {"bigint": "long", "int": "long", "double": "double", "float": "double"}


def append(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; missing columns are null, columns of several types become double if all are numbers, else text."""
    columns = list(dict.fromkeys(c for f in frames for c in f.columns))
    out = None
    for f in frames:
        picks = []
        for c in columns:
            kinds = {dict(g.dtypes)[c] for g in frames if c in g.columns}
            kind = kinds.pop() if len(kinds) == 1 else ("double" if kinds <= set(NUMBERS) else "string")
            picks.append((F.col(f"`{c}`") if c in f.columns else F.lit(None)).cast(kind).alias(c))
        one = f.select(*picks)
        out = one if out is None else out.unionByName(one)
    return out
