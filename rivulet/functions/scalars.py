"""Scalar functions on columns: python-like arithmetic, strings, JSON held as text."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_floordiv(a: Column, b: Column) -> Column:
    """a // b of whole numbers, exact at any size; null if b is 0."""
    a, b = a.cast("long"), F.nullif(b.cast("long"), F.lit(0).cast("long"))
    cut = F.call_function("div", a, b)
    return cut - F.when((a % b != 0) & ((a < 0) != (b < 0)), 1).otherwise(0)


def int_mod(a: Column, b: Column) -> Column:
    """a % b of whole numbers with the sign of b; null if b is 0."""
    a, b = a.cast("long"), F.nullif(b.cast("long"), F.lit(0).cast("long"))
    rest = a % b
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


def floordiv(a: Column, b: Column) -> Column:
    """a // b as python has it, for negative numbers too, in double precision; null if b is 0."""
    return F.floor(a / F.nullif(b.cast("double"), F.lit(0.0))).cast("long")


def mod(a: Column, b: Column) -> Column:
    """a % b with the sign of b, in double precision; null if b is 0."""
    b = F.nullif(b.cast("double"), F.lit(0.0))
    return a - F.floor(a / b) * b


def to_uuid(c: Column) -> Column:
    """Lower-case text of a uuid; null for other texts."""
    low = F.lower(F.trim(c))
    return F.when(low.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), low)


def power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def round_half_up(c: Column, decimals: int = 0) -> Column:
    """Half away from zero, on decimals rather than binary fractions."""
    return F.round(c.cast("decimal(38,12)"), decimals).cast("double")


def to_int(c: Column) -> Column:
    """Floats round instead of being cut off."""
    return F.round(c.cast("double")).cast("long")


def to_bool(c: Column) -> Column:
    return c.cast("double") != 0


def str_slice(c: Column, start: int | None = None, stop: int | None = None) -> Column:
    """text[start:stop] of python, with bounds from either end."""
    n = F.length(c)
    low = F.lit(0) if start is None else (F.least(F.lit(start), n) if start >= 0 else F.greatest(F.lit(0), n + start))
    high = n if stop is None else (F.least(F.lit(stop), n) if stop >= 0 else F.greatest(F.lit(0), n + stop))
    return F.substring(c, low + 1, F.greatest(F.lit(0), high - low))


def str_replace(c: Column, pat: str, repl: str) -> Column:
    return F.replace(c, F.lit(pat), F.lit(repl))


def json_canonical(c: Column) -> Column:
    """JSON text with ordered keys and no spaces: equal values are equal texts."""
    return F.to_json(F.try_parse_json(c))


def json_value(c: Column, key: str | int, as_str: bool = False) -> Column:
    """A key of an object or an item of an array (negative: from the end); as text or as JSON."""
    if isinstance(key, int):
        item = F.try_element_at(json_items(c), F.lit(key + 1 if key >= 0 else key))
    else:
        if '"' in key:
            raise ValueError("keys with double quotes can't be looked up")
        item = F.try_variant_get(F.try_parse_json(c), f'$["{key}"]', "variant")
    return F.try_variant_get(item, "$", "string") if as_str else F.to_json(item)


def json_items(c: Column) -> Column:
    return F.from_json(c, "array<variant>")


def json_length(c: Column) -> Column:
    return F.json_array_length(c)


def json_contains(c: Column, item: object) -> Column:
    return F.exists(json_items(c), lambda e: F.to_json(e) == json.dumps(item, separators=(",", ":")))


def _matches(e: Column, want: dict) -> Column:
    out = F.lit(True)
    for k, v in want.items():
        out = out & F.coalesce(F.try_variant_get(e, f'$["{k}"]', "string") == F.lit(v if isinstance(v, str) else json.dumps(v)), F.lit(False))
    return out


def json_find(c: Column, want: dict) -> Column:
    """Position of the first object that holds all of want; null if none does."""
    at = F.array_position(F.transform(json_items(c), lambda e: _matches(e, want)), F.lit(True))
    return F.when(at > 0, at - 1)


def json_slice(c: Column, start: int | dict | None = None, stop: int | dict | None = None) -> Column:
    """A part of an array; a dict bound stands for the first object that holds it, included at the end too."""
    n = json_length(c)

    def bound(b: int | dict | None, end: bool) -> Column:
        if b is None:
            return n if end else F.lit(0)
        if isinstance(b, dict):
            return json_find(c, b) + (1 if end else 0)
        return F.least(F.lit(b), n) if b >= 0 else F.greatest(F.lit(0), n + b)

    low, high = bound(start, False), bound(stop, True)
    some = F.slice(json_items(c), (low + 1).cast("int"), F.greatest(F.lit(0), high - low).cast("int"))
    return F.when((low >= 0) & (high > low), F.to_json(some)).otherwise(F.when(c.isNotNull(), F.lit("[]")))
