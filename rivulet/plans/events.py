"""From raw events to sessions: context extraction, identities, sessionising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import json_slice

SESSION_GAP_SECONDS = 1800
CONTEXT = "array<map<string,string>>"


def contexts(text: Column) -> Column:
    """A JSON list of contexts as an array of maps; nested values stay JSON text."""
    return F.from_json(text, CONTEXT)


def context_value(text: Column, kind: str, key: str) -> Column:
    """A key of the first context of a type; null if there is none."""
    return F.get(F.filter(contexts(text), lambda c: c["_type"] == kind), F.lit(0))[key]


def extract_contexts(raw: DataFrame) -> DataFrame:
    """event_id, day, moment, user_id, global_contexts, location_stack, event_type, stack_event_types of raw rows with a JSON value.

    Each value is parsed once, and filters of what it holds are met after that, not by parsing it again. The last of equal keys counts.
    """
    found = F.json_tuple("value", "global_contexts", "location_stack", "_type", "_types").alias("global_contexts", "location_stack", "event_type", "_types")
    df = raw.select("event_id", "day", "moment", F.col("cookie_id").alias("user_id"), found)
    return df.select(*df.columns[:-1], F.from_json("_types", "array<string>").alias("stack_event_types"))


def dedup_events(df: DataFrame, id_col: str = "event_id", by: str = "moment") -> DataFrame:
    """The earliest row of each event id."""
    w = Window.partitionBy(id_col).orderBy(by)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resolve_identities(df: DataFrame, identity_id: str | None = None) -> DataFrame:
    """user_id becomes value|id of the last identity context of the user, where there is one."""
    own = F.filter(contexts(F.col("global_contexts")), lambda c: (c["_type"] == "IdentityContext") & (F.lit(identity_id is None) | (c["id"] == F.lit(identity_id))))
    first = F.get(own, F.lit(0))
    found = df.select(F.col("user_id").alias("_u"), "moment", "event_id", F.concat(first["value"], F.lit("|"), first["id"]).alias("_identity")).where("_identity IS NOT NULL")
    last = found.groupBy("_u").agg(F.max_by("_identity", F.struct("moment", "event_id")).alias("_identity"))
    out = df.join(last, df["user_id"] == last["_u"], "left")
    return out.withColumn("user_id", F.coalesce("_identity", "user_id")).drop("_u", "_identity")


def anonymize(df: DataFrame) -> DataFrame:
    """user_id is null where no identity was resolved."""
    return df.withColumn("user_id", F.when(F.col("user_id").contains("|"), F.col("user_id")))


def sessionize(df: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS, user: str = "user_id", moment: str = "moment", event: str = "event_id") -> DataFrame:
    """session_id and session_hit_number: a session ends when its user is away for longer than the gap.

    Sessions are numbered by their first (moment, event). All that is counted within a user comes
    from one pass over the user's sorted events; only session starts are numbered over all users,
    see number_rows. An event without a moment is a session of its own, before all others.
    """
    w = Window.partitionBy(user).orderBy(moment, event)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    away = F.timestamp_diff("MICROSECOND", F.lag(moment).over(w), F.col(moment)) > gap_seconds * 1_000_000
    out = df.withColumn("_start", F.coalesce(away, F.lit(True)).cast("int")).withColumn("_n", F.row_number().over(w))
    out = out.withColumn("_k", F.sum("_start").over(upto)).withColumn("_first", F.max(F.when(F.col("_start") == 1, F.col("_n"))).over(upto))
    starts = out.where("_start = 1").select(F.col(user).alias("_su"), F.col("_k").alias("_sk"), F.col(moment).alias("_m"), F.col(event).alias("_e"))
    ranked = number_rows(starts, ["_m", "_e"], "session_id")
    out = out.withColumn("session_hit_number", (F.col("_n") - F.col("_first") + 1).cast("long"))
    out = out.join(ranked.select("_su", "_sk", "session_id"), F.col(user).eqNullSafe(F.col("_su")) & (F.col("_k") == F.col("_sk")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "session_id", "session_hit_number")


def number_rows(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Numbers from 1 over a whole frame in an order whose first key is a timestamp, nulls first, without gathering it in one task.

    Rows are counted by second with partial sums; seconds are summed up within their hour, and
    hours over all, which is one row an hour. A row's number is its place in its second after those.
    """
    df = df.withColumn("_second", F.date_trunc("second", by[0]))
    counts = df.groupBy("_second").agg(F.count(F.lit(1)).alias("_c")).withColumn("_hour", F.date_trunc("hour", "_second"))
    hours = counts.groupBy(F.col("_hour").alias("_h")).agg(F.sum("_c").alias("_hc"))
    earlier = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = hours.select("_h", earlier("_hc", Window.orderBy("_h")).alias("_hb"))
    before = counts.withColumn("_sb", earlier("_c", Window.partitionBy("_hour").orderBy("_second")))
    before = before.join(F.broadcast(hours), F.col("_hour").eqNullSafe(F.col("_h"))).select(F.col("_second").alias("_s"), (F.col("_sb") + F.col("_hb")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_second").orderBy(*by))
    out = df.withColumn("_place", place).join(before, F.col("_second").eqNullSafe(F.col("_s")))
    return out.withColumn(name, F.col("_before") + F.col("_place")).drop("_second", "_place", "_s", "_before")


def session_frame(raw: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS, identity_id: str | None = None, resolve: bool = False, anonymous: bool = False) -> DataFrame:
    """Raw events to the session frame; users are made anonymous after sessions are found."""
    df = dedup_events(extract_contexts(raw))
    df = sessionize(resolve_identities(df, identity_id) if resolve else df, gap_seconds)
    return anonymize(df) if anonymous else df


def nice_name(stack: Column) -> Column:
    """'Link: a located at Web Document: b => Navigation: c' of a location stack."""
    spaced = lambda t: F.regexp_replace(F.regexp_replace(t, "Context$", ""), "(?<!^)([A-Z])", " $1")
    named = F.transform(contexts(stack), lambda c: F.concat(spaced(c["_type"]), F.lit(": "), c["id"]))

    def joined(names: Column) -> Column:
        n = F.size(names)
        last = F.element_at(names, -1)
        above = F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), " => ")
        return F.when(n == 0, F.lit(None)).when(n == 1, last).otherwise(F.concat(last, F.lit(" located at "), above))

    return F.get(F.transform(F.array(named), joined), F.lit(0))  # a variable, or each mention would parse the stack again


def navigation_features(stack: Column) -> Column:
    """The part of a location stack from its first navigation on; an empty list where there is none."""
    return json_slice(stack, {"_type": "NavigationContext"})


def feature_stack(stack: Column) -> Column:
    """A location stack with the type and the id of each context alone."""
    kept = F.transform(F.from_json(stack, "array<struct<_type:string,id:string>>"), lambda c: F.struct(c["_type"].alias("_type"), c["id"].alias("id")))
    return F.when(stack.isNotNull(), F.to_json(kept))


def application(text: Column) -> Column:
    return context_value(text, "ApplicationContext", "id")


def cookie_id(text: Column) -> Column:
    return context_value(text, "CookieIdContext", "cookie_id")


def user_agent(text: Column) -> Column:
    return context_value(text, "HttpContext", "user_agent")


#: Columns of a session frame and their types.
COLUMNS = {
    "event_id": ("string", "bigint"), "day": ("date",), "moment": ("timestamp_ntz", "timestamp"), "user_id": ("string", "bigint"), "global_contexts": ("string",), "location_stack": ("string",),
    "event_type": ("string",), "stack_event_types": ("array<string>",), "session_id": ("bigint",), "session_hit_number": ("bigint",),
}


def check_frame(df: DataFrame, columns: list[str] | None = None, check_types: bool = True) -> None:
    """A ValueError if a needed column is missing or of another type."""
    kinds = dict(df.dtypes)
    for c in COLUMNS if columns is None else columns:
        if c not in kinds:
            raise ValueError(f"column {c} is missing")
        if check_types and c in COLUMNS and kinds[c] not in COLUMNS[c]:
            raise ValueError(f"column {c} is of type {kinds[c]}, not {COLUMNS[c][0]}")
