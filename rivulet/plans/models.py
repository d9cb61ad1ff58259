"""Product-analytics models over a session frame: user_id, session_id, session_hit_number, moment, event_id, event_type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import strftime

TIME_FORMAT = "%Y-%m-%d %H:%M:%S.%f"
#: Time periods of the retention matrix: the part that a moment is cut to, and how many lie between two.
PERIODS = {"daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}


def time_agg(moment: Column, fmt: str | None = None) -> Column:
    return strftime(moment, fmt or TIME_FORMAT)


def _distinct(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    agg = F.count_distinct(column).alias(name)
    return df.groupBy(*by).agg(agg) if by else df.agg(agg)


def unique_users(df: DataFrame, by: list[str]) -> DataFrame:
    return _distinct(df, by, "user_id", "unique_users")


def unique_sessions(df: DataFrame, by: list[str]) -> DataFrame:
    return _distinct(df, by, "session_id", "unique_sessions")


def session_duration(df: DataFrame, by: list[str], exclude_bounces: bool = True, method: str = "mean") -> DataFrame:
    """Mean or sum of the seconds from a session's first to last event."""
    each = df.groupBy(*by, "session_id").agg((F.timestamp_diff("MICROSECOND", F.min("moment"), F.max("moment")) / 1e6).alias("_s"))
    each = each.where("_s > 0") if exclude_bounces else each
    agg = {"mean": F.avg, "sum": F.sum}[method]("_s").alias("session_duration")
    return each.groupBy(*by).agg(agg) if by else each.agg(agg)


def frequency(df: DataFrame) -> DataFrame:
    """Users by their number of sessions."""
    each = df.groupBy("user_id").agg(F.count_distinct("session_id").alias("session_id"))
    return each.groupBy("session_id").agg(F.count_distinct("user_id").alias("unique_users"))


def is_first_session() -> Column:
    return F.col("session_id") == F.min("session_id").over(Window.partitionBy("user_id"))


def is_new_user(period: Column) -> Column:
    """Whether the event's period is the one of the user's first session."""
    return F.min("session_id").over(Window.partitionBy("user_id", period)) == F.min("session_id").over(Window.partitionBy("user_id"))


def conversions_in_time(converted: Column, partition: str = "session_id") -> Column:
    """Running count of conversions; events of one moment share it."""
    return F.sum(converted.cast("long")).over(Window.partitionBy(partition).orderBy("moment"))


def conversions_counter(converted: Column, partition: str = "session_id") -> Column:
    return F.sum(converted.cast("long")).over(Window.partitionBy(partition))


def pre_conversion_hits(df: DataFrame, converted: Column, partition: str = "session_id") -> DataFrame:
    """pre_conversion_hit_number: hits left until the first conversion (1: the last before it), null elsewhere."""
    df = df.withColumn("_all", conversions_counter(converted, partition)).withColumn("_now", conversions_in_time(converted, partition))
    before = (F.col("_all") > 0) & (F.col("_now") == 0)
    back = Window.partitionBy(partition).orderBy(F.desc("session_hit_number")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.when(before, F.sum(before.cast("long")).over(back))
    return df.withColumn("pre_conversion_hit_number", number).drop("_all", "_now")


def top_features(df: DataFrame, by: list[str]) -> DataFrame:
    """Users of each feature, most first; rows with a null key are left out.

    They are left out as groups: a filter of rows would be moved below what makes the keys, and make them twice.
    """
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    out = df.groupBy(*by).agg(F.count_distinct("user_id").alias("unique_users"), F.bool_and(known).alias("_known"))
    return out.where("_known").drop("_known").orderBy(F.desc("unique_users"), *by)


def top_features_before_conversion(df: DataFrame, converted: Column, by: list[str]) -> DataFrame:
    return top_features(pre_conversion_hits(df, converted).where("pre_conversion_hit_number IS NOT NULL"), by)


def retention_matrix(df: DataFrame, period: str = "monthly", n: int = 4, start: str | None = None, end: str | None = None, percentage: bool = False, event_type: str | None = None) -> DataFrame:
    """Users of each cohort (the period of their first event) in the first n periods: first_cohort, _0 .. _(n-1); null where none."""
    part = PERIODS[period]
    if event_type:
        df = df.where(F.array_contains("stack_event_types", event_type) if "stack_event_types" in df.columns else F.col("event_type") == event_type)
    if end:
        df = df.where(F.col("moment") < F.lit(end).cast("timestamp_ntz"))
    at = F.date_trunc(part, "moment").cast("timestamp_ntz")
    seen = df.select("user_id", at.alias("_p")).distinct()  # one row a user and period, before the window
    seen = seen.withColumn("_f", F.min("_p").over(Window.partitionBy("user_id")))
    if start:
        seen = seen.where(F.col("_f") >= F.lit(start).cast("timestamp_ntz"))
    seen = seen.withColumn("_d", F.timestamp_diff(part.upper(), F.col("_f"), F.col("_p")))
    counts = [F.count_if(F.col("_d") == k).alias(f"_{k}") for k in range(n)]
    out = seen.groupBy(F.date_format("_f", "yyyy-MM-dd").alias("first_cohort")).agg(*counts)
    picks = [F.when(F.col(f"_{k}") > 0, F.col(f"_{k}") / F.col("_0") * 100 if percentage else F.col(f"_{k}")).alias(f"_{k}") for k in range(n)]
    return out.select("first_cohort", *picks)


def accuracy_score(df: DataFrame, label: str, predicted: Column) -> float | None:
    """The share of rows whose prediction is right; rows without a label or a prediction count as wrong."""
    same = F.coalesce(F.col(label).cast("boolean") == predicted.cast("boolean"), F.lit(False))
    return df.agg(F.avg(same.cast("int"))).first()[0]


class LogisticRegression:
    """A classifier fitted by Spark's own solver; predictions are column arithmetic."""

    def __init__(self, c: float = 1.0, max_iter: int = 100):
        self.c, self.max_iter = c, max_iter
        self.weights: dict[str, float] = {}
        self.intercept = 0.0

    def fit(self, df: DataFrame, features: list[str], label: str) -> LogisticRegression:
        from pyspark.ml.classification import LogisticRegression as Fit
        from pyspark.ml.feature import VectorAssembler

        rows = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df.select(*features, F.col(label).cast("double").alias("_y")))
        n = max(1, rows.count())
        model = Fit(featuresCol="_x", labelCol="_y", regParam=1 / (self.c * n), elasticNetParam=0.0, standardization=False, maxIter=self.max_iter).fit(rows)
        self.weights = dict(zip(features, model.coefficients.toArray().tolist(), strict=True))
        self.intercept = float(model.intercept)
        return self

    def predict_proba(self) -> Column:
        x = F.lit(self.intercept)
        for c, w in self.weights.items():
            x = x + F.col(c) * w
        return 1 / (1 + F.exp(-x))

    def predict(self) -> Column:
        return self.predict_proba() > 0.5

    def score(self, df: DataFrame, label: str) -> float:
        return accuracy_score(df, label, self.predict())
