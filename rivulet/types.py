"""Names of types as users write them, and classes of their own for values of a type."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql.types import DataType

#: Names of types and Spark's.
NAMES = {
    "int64": "bigint", "float64": "double", "string": "string", "bool": "boolean", "timestamp": "timestamp_ntz", "date": "date", "time": "string",
    "timedelta": "interval day to second", "json": "string", "uuid": "string", "numeric_interval": "struct<lower:double,upper:double,bounds:string>",
}
VALUES = {bool: "bool", int: "int64", float: "float64", str: "string", datetime.datetime: "timestamp", datetime.date: "date", datetime.time: "time", datetime.timedelta: "timedelta", uuid.UUID: "uuid", dict: "json", list: "json"}


class TypeRegistry:
    def __init__(self):
        self.names, self.values, self.classes = dict(NAMES), dict(VALUES), {}

    def register(self, name: str, spark_type: str, values: tuple[type, ...] = (), override: bool = False):
        """Decorator: a Series class for a type of this name, also of those python values."""

        def add(cls):
            taken = [v for v in values if v in self.values]
            if not override and (name in self.names or taken):
                raise ValueError(f"{name} or {taken} is registered already")
            self.names[name] = spark_type
            self.classes[name] = cls
            self.values |= dict.fromkeys(values, name)
            return cls

        return add

    def spark_type(self, name: str) -> DataType:
        return DataType.fromDDL(self.names.get(name, name))

    def name_of(self, kind: DataType) -> str:
        """The first name of a Spark type, or its own text."""
        text = kind.simpleString()
        return next((n for n, t in self.names.items() if t == text), text)

    def of_value(self, value) -> str:
        for kind in type(value).__mro__:
            if kind in self.values:
                return self.values[kind]
        raise ValueError(f"no type for {type(value).__name__}")

    def series(self, frame, column: str):
        """The column as its type's own class, or as a plain series."""
        out = frame.series(column)
        cls = self.classes.get(self.name_of(frame.df.schema[column].dataType))
        return cls(out.frame, out.column, out.name) if cls else out


REGISTRY = TypeRegistry()


def parse_type(text: str) -> DataType:
    """Types in text, also with fields: ARRAY<STRUCT<a INT64, b STRING>> and Spark's own."""
    out = text.lower()
    for name in ("int64", "float64", "bool"):
        out = out.replace(name, NAMES[name])
    return DataType.fromDDL(out)


def same_type(a: DataType, b: DataType) -> bool:
    """Whether two types are of the same structure, whatever may be null."""
    return a.simpleString() == b.simpleString()
