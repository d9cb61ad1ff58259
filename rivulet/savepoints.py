"""Named points of a frame's way, written as views or tables when asked for."""

from __future__ import annotations

import re
from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark.sql import SparkSession

if TYPE_CHECKING:
    from .frame import Frame

KINDS = ("query", "view", "table")


def check(name: str, materialization: str, known: dict) -> None:
    if not re.fullmatch(r"[a-zA-Z_][a-zA-Z0-9_]*", name):
        raise ValueError(f"{name} isn't a name")
    if name in known:
        raise ValueError(f"there is a savepoint {name} already")
    if materialization not in KINDS:
        raise ValueError(f"a savepoint is one of {KINDS}")


class Savepoints:
    """The savepoints of a frame by name; their order is that in which they were set."""

    def __init__(self, frame: Frame | None = None):
        self.points: dict[str, tuple[Frame, str]] = dict(frame.savepoints) if frame else {}

    def add_savepoint(self, name: str, frame: Frame, materialization: str = "query") -> None:
        check(name, materialization, self.points)
        self.points[name] = (frame, materialization)

    def remove_savepoint(self, name: str) -> None:
        del self.points[name]

    def set_materialization(self, name: str, materialization: str) -> None:
        frame, _ = self.points[name]
        check(name, materialization, {})
        self.points[name] = (frame, materialization)

    def get_df(self, name: str) -> Frame:
        return self.points[name][0]

    def write(self, spark: SparkSession, overwrite: bool = False) -> dict[str, Frame]:
        """Write all views and tables; a frame that reads each of them, by name."""
        for name, (frame, kind) in self.points.items():
            if kind == "table":
                frame.to_spark().write.mode("overwrite" if overwrite else "errorifexists").saveAsTable(name)
            elif kind == "view":
                if not overwrite and spark.catalog.tableExists(name):
                    raise ValueError(f"there is a {name} already")
                frame.to_spark().createOrReplaceTempView(name)
        return {name: self.get_materialized_df(spark, name) for name in self.points}

    def get_materialized_df(self, spark: SparkSession, name: str) -> Frame:
        """A frame that reads what was written, or the frame itself for a query."""
        frame, kind = self.points[name]
        return frame if kind == "query" else replace(frame, df=spark.table(name), order=(), steps=(), source=None, origin=None, variables={})

    def create_statements(self) -> dict[str, str]:
        """SQL that makes each view and table from the frame's own temporary view."""
        return {n: f"CREATE {kind.upper()} `{n}` AS {frame.view_sql(f'__{n}')}" for n, (frame, kind) in self.points.items() if kind != "query"}

    def drop_statements(self) -> dict[str, str]:
        return {n: f"DROP {kind.upper()} IF EXISTS `{n}`" for n, (_, kind) in reversed(self.points.items()) if kind != "query"}
