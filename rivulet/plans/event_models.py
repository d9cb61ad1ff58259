"""Models of product analytics under one roof: named conversions, and models that need them."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import event_table
from . import events, models


def needs(*columns: str):
    """A model that reads these columns: they are checked, and no others are carried along unless keep is given."""

    def wrap(model):
        @wraps(model)
        def checked(self, df: DataFrame, *args, **options):
            events.check_frame(df, list(columns), check_types=False)
            return model(self, df, *args, **options)

        return checked

    return wrap


class EventModels:
    """Settings, and the models as methods: agg gives new frames, map gives columns for the frame's rows."""

    def __init__(self, time_aggregation: str = models.TIME_FORMAT):
        self.time_aggregation = time_aggregation
        self.conversions: dict[str, tuple[Column | None, str | None]] = {}
        self.agg, self.map = Aggregates(self), Maps(self)

    def session_frame(self, spark: SparkSession, path: str, start_date: str | None = None, end_date: str | None = None, **options) -> DataFrame:
        """Raw events of those days as sessions."""
        return events.session_frame(event_table(spark, path, start_date, end_date), **options)

    def time_agg(self, moment: Column, fmt: str | None = None) -> Column:
        return models.time_agg(moment, fmt or self.time_aggregation).alias("time_aggregation")

    def add_conversion_event(self, location_stack: Column | None = None, event_type: str | None = None, name: str | None = None) -> str:
        """Events of a type, or whose part of the location stack isn't empty, or both; the name it got."""
        if location_stack is None and event_type is None:
            raise ValueError("a conversion needs a location stack or an event type")
        name = name or f"conversion_{len(self.conversions) + 1}"
        self.conversions[name] = (location_stack, event_type)
        return name

    def conversion(self, name: str) -> Column:
        if name not in self.conversions:
            raise KeyError(f"no conversion is named {name}")
        stack, kind = self.conversions[name]
        out = F.lit(True)
        if stack is not None:
            out = out & (F.coalesce(F.json_array_length(stack), F.lit(0)) > 0)
        return out & (F.col("event_type") == kind) if kind is not None else out

    def logistic_regression(self, **options) -> models.LogisticRegression:
        return models.LogisticRegression(**options)


class Maps:
    def __init__(self, owner: EventModels):
        self.models = owner

    @needs("event_type")
    def is_conversion_event(self, df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("is_conversion_event", F.coalesce(self.models.conversion(name), F.lit(False)))

    @needs("session_id", "moment", "event_type")
    def conversions_in_time(self, df: DataFrame, name: str, partition: str = "session_id") -> DataFrame:
        return df.withColumn("conversions_in_time", models.conversions_in_time(F.coalesce(self.models.conversion(name), F.lit(False)), partition))

    @needs("session_id", "event_type")
    def conversions_counter(self, df: DataFrame, name: str, partition: str = "session_id") -> DataFrame:
        return df.withColumn("conversions_counter", models.conversions_counter(F.coalesce(self.models.conversion(name), F.lit(False)), partition))

    @needs("session_id", "session_hit_number", "moment", "event_type")
    def pre_conversion_hit_number(self, df: DataFrame, name: str, partition: str = "session_id") -> DataFrame:
        return models.pre_conversion_hits(df, F.coalesce(self.models.conversion(name), F.lit(False)), partition)

    @needs("user_id", "session_id")
    def is_first_session(self, df: DataFrame) -> DataFrame:
        return df.withColumn("is_first_session", models.is_first_session())

    @needs("user_id", "session_id", "moment")
    def is_new_user(self, df: DataFrame, fmt: str | None = None) -> DataFrame:
        return df.withColumn("is_new_user", models.is_new_user(self.models.time_agg(F.col("moment"), fmt)))


class Aggregates:
    def __init__(self, owner: EventModels):
        self.models = owner

    def _by(self, df: DataFrame, by: list[str] | None, taken: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
        """Groups: of the default time aggregation unless given; not by what is counted."""
        if by is None:
            return df.withColumn("time_aggregation", self.models.time_agg(F.col("moment"))), ["time_aggregation"]
        wrong = [c for c in by if c in taken]
        if wrong:
            raise ValueError(f"groups can't be by {wrong}")
        return df, by

    @needs("user_id", "moment")
    def unique_users(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        return models.unique_users(*self._by(df, by, ("user_id",)))

    @needs("session_id", "moment")
    def unique_sessions(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        return models.unique_sessions(*self._by(df, by, ("session_id",)))

    @needs("session_id", "moment")
    def session_duration(self, df: DataFrame, by: list[str] | None = None, **options) -> DataFrame:
        return models.session_duration(*self._by(df, by, ("session_id",)), **options)

    @needs("user_id", "session_id")
    def frequency(self, df: DataFrame) -> DataFrame:
        return models.frequency(df)

    @needs("user_id", "moment")
    def retention_matrix(self, df: DataFrame, **options) -> DataFrame:
        return models.retention_matrix(df, **options)

    def _features(self, df: DataFrame, stack: Column | None, event_type: str) -> DataFrame:
        """Users of each application, feature and event type, most first; rows that lack one of them are left out."""
        df = df.where(F.array_contains("stack_event_types", event_type))
        df = df.withColumns({"application": events.application(F.col("global_contexts")), "feature_nice_name": events.nice_name(F.col("location_stack") if stack is None else stack)})
        return models.top_features(df, ["application", "feature_nice_name", "event_type"])

    @needs("global_contexts", "location_stack", "user_id", "stack_event_types", "event_type")
    def top_product_features(self, df: DataFrame, location_stack: Column | None = None, event_type: str = "InteractiveEvent") -> DataFrame:
        return self._features(df, location_stack, event_type).withColumnRenamed("unique_users", "user_id_nunique")

    @needs("global_contexts", "location_stack", "user_id", "stack_event_types", "event_type", "session_id", "moment")
    def top_product_features_before_conversion(self, df: DataFrame, name: str, location_stack: Column | None = None, event_type: str = "InteractiveEvent") -> DataFrame:
        """The same, of the hits of sessions that convert, before they do."""
        converted = F.coalesce(self.models.conversion(name), F.lit(False))
        marked = df.withColumn("_all", models.conversions_counter(converted)).withColumn("_now", models.conversions_in_time(converted))
        return self._features(marked.where("_all >= 1 AND _now = 0").drop("_all", "_now"), location_stack, event_type)
