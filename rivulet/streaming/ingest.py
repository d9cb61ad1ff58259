"""Event ingestion: checks of a raw event, and a stream that keeps good events once and the others with a reason."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_EVENT_AGE_MS = 3_600_000
#: Columns of an event that are needed, and the types that each event type inherits.
SCHEMA = "id string, _type string, time long, global_contexts string, location_stack string"
UTM = ("source", "medium", "campaign", "term", "content", "source_platform", "creative_format", "marketing_tactic")
#: Folders of events in files: kept, rejected, as they came.
VERDICTS = ("OK", "NOK", "RAW")
#: Limits of a request.
MAX_REQUEST_BYTES, MAX_REQUEST_EVENTS = 1_000_000, 1_000


def correct_clock(time: Column, transport_time: Column, now_ms: Column) -> Column:
    """Event time in server time: shifted by how far the client's clock is behind."""
    return time + (now_ms - transport_time)


def marketing(url: Column) -> Column:
    """A struct of the utm parameters of a URL; null without source, medium and campaign."""
    parts = {k: F.try_url_decode(F.replace(F.try_parse_url(url, F.lit("QUERY"), F.lit(f"utm_{k}")), F.lit("+"), F.lit(" "))) for k in UTM}
    made = F.struct(*[c.alias(k) for k, c in parts.items()])
    return F.when(parts["source"].isNotNull() & parts["medium"].isNotNull() & parts["campaign"].isNotNull(), made)


def _with_context(contexts: Column, made: Column) -> Column:
    """JSON contexts and one more, given as a struct, unless that is null."""
    known = F.coalesce(F.from_json(contexts, "array<variant>"), F.array().cast("array<variant>"))
    return F.when(made.isNull(), contexts).otherwise(F.to_json(F.concat(known, F.array(F.try_parse_json(F.to_json(made))))))


def add_marketing_context(df: DataFrame) -> DataFrame:
    """global_contexts with a marketing context, where the first path context's URL names source, medium and campaign."""
    paths = F.filter(F.from_json("global_contexts", "array<map<string,string>>"), lambda c: c["_type"] == "PathContext")
    found = marketing(F.get(paths, F.lit(0))["id"])
    made = F.when(found.isNotNull(), F.struct(F.lit("MarketingContext").alias("_type"), F.lit("utm").alias("id"), *[found[k].alias(k) for k in UTM]))
    return df.withColumn("global_contexts", _with_context(F.col("global_contexts"), made))


def add_http_context(df: DataFrame, referrer: Column, user_agent: Column, remote_address: Column | None = None) -> DataFrame:
    """global_contexts with what the request said of itself."""
    made = F.struct(F.lit("HttpContext").alias("_type"), F.lit("http_context").alias("id"), F.coalesce(referrer, F.lit("")).alias("referrer"), F.coalesce(user_agent, F.lit("")).alias("user_agent"), *([remote_address.alias("remote_address")] if remote_address is not None else []))
    return df.withColumn("global_contexts", _with_context(F.col("global_contexts"), made))


def add_cookie_context(df: DataFrame, cookie_id: Column) -> DataFrame:
    """global_contexts with the cookie, where there is one."""
    made = F.when(cookie_id.isNotNull(), F.struct(F.lit("CookieIdContext").alias("_type"), cookie_id.alias("id"), cookie_id.alias("cookie_id")))
    return df.withColumn("global_contexts", _with_context(F.col("global_contexts"), made))


def request_events(requests: DataFrame, body: str = "body", received_ms: str = "received_ms") -> DataFrame:
    """The events of JSON requests {"events": [...], "transport_time": ms}, their times in server time.

    Requests that are too large, hold too many events or aren't of that form give no events; see
    bad_requests.
    """
    form = "struct<events: array<variant>, transport_time: long>"
    parsed = requests.where(~_bad(F.col(body))).withColumn("_r", F.from_json(body, form))
    each = parsed.select(F.explode("_r.events").alias("_e"), F.col("_r.transport_time").alias("_sent"), F.col(received_ms).alias("_now"))
    at = lambda k, kind="string": F.try_variant_get("_e", f"$.{k}", kind)
    return each.select(
        at("id").alias("id"), at("_type").alias("_type"), correct_clock(at("time", "long"), F.coalesce("_sent", "_now"), F.col("_now")).alias("time"),
        F.coalesce(F.to_json(at("global_contexts", "variant")), F.lit("[]")).alias("global_contexts"), F.coalesce(F.to_json(at("location_stack", "variant")), F.lit("[]")).alias("location_stack"),
    )


def _bad(body: Column) -> Column:
    n = F.json_array_length(F.get_json_object(body, "$.events"))
    return F.coalesce((F.octet_length(body) > MAX_REQUEST_BYTES) | n.isNull() | (n > MAX_REQUEST_EVENTS), F.lit(True))


def bad_requests(requests: DataFrame, body: str = "body") -> DataFrame:
    return requests.where(_bad(F.col(body)))


def enqueue(events: DataFrame, path: str) -> None:
    """Events to a queue folder, which a stream reads in portions and keeps its place in."""
    events.write.mode("append").json(path)


def queued(spark: SparkSession, path: str, files_per_batch: int = 200) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def reject_reason(now_ms: Column, required: dict[str, list[str]]) -> Column:
    """Why an event isn't kept, null if it is: unknown type, missing id, missing contexts, too old or in the future."""
    kinds = F.transform(F.from_json("global_contexts", "array<map<string,string>>"), lambda c: c["_type"])
    kinds = F.coalesce(kinds, F.array().cast("array<string>"))
    needed = F.create_map(*[x for k, v in required.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]).cast("array<string>"))])
    lacking = F.size(F.array_except(F.try_element_at(needed, F.col("_type")), kinds)) > 0
    return (
        F.when(F.col("id").isNull(), "no_id")
        .when(F.col("_type").isNull() | ~F.col("_type").isin(*required), "unknown_type")
        .when(lacking, "missing_context")
        .when(F.col("time").isNull() | (F.col("time") < now_ms - MAX_EVENT_AGE_MS), "too_old")
        .when(F.col("time") > now_ms, "in_future")
    )


def split_batch(batch: DataFrame, now_ms: Column, required: dict[str, list[str]], known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) of a batch: one row for each id, its earliest; ids that are known already are rejected as duplicates.

    Known events are only read for their ids, and are met with the batch's: those are few, so that
    Spark sends them by their size, and what was kept before isn't shuffled.
    """
    judged = batch.withColumn("reason", reject_reason(now_ms, required))
    rows = judged.where("reason IS NULL").drop("reason")
    earliest = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct("time", "_type", "global_contexts", "location_stack"))
    good = rows.groupBy(F.col("id").alias("_id")).agg(earliest.alias("_row")).select("_row.*")
    bad = judged.where("reason IS NOT NULL")
    if known is not None:
        ids = good.select(F.col("id").alias("_id"))
        seen = known.select(F.col("id").alias("_known")).join(ids, F.col("_known") == F.col("_id"), "left_semi").distinct()
        met = good.join(seen, F.col("id") == F.col("_known"), "left")
        bad = bad.unionByName(met.where("_known IS NOT NULL").drop("_known").withColumn("reason", F.lit("duplicate")))
        good = met.where("_known IS NULL").drop("_known")
    return good, bad


def write_files(events: DataFrame, path: str, verdict: str, arrived_ms: Column | None = None) -> None:
    """Events as lines of JSON below path/verdict=.../day=..., on any file system that Spark writes to, object stores too.

    verdict: OK, NOK or RAW. The day is that of arrival, now if it isn't given; events without one
    are kept under Hive's name for null. Files are added to what is there.
    """
    if verdict not in VERDICTS:
        raise ValueError(f"a verdict is one of {VERDICTS}")
    at = F.current_timestamp() if arrived_ms is None else F.timestamp_millis(arrived_ms)
    events.withColumns({"verdict": F.lit(verdict), "day": F.to_date(at)}).write.mode("append").partitionBy("verdict", "day").json(path)


def start(stream: DataFrame, good_path: str, bad_path: str, checkpoint: str, required: dict[str, list[str]], now_ms: Column | None = None, **trigger):
    """Write a stream of events to two Parquet folders; batches that are run again add nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
        try:
            known = spark.read.parquet(good_path).where(F.col("_batch") != number)
        except AnalysisException as e:  # nothing is written yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            known = None
        good, bad = split_batch(batch, now, required, known)
        for df, path in ((good, good_path), (bad, bad_path)):
            df.withColumn("_batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
