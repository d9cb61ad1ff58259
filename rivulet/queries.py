"""Registered queries on the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import Frame
from .functions import scalars, temporal
from .operators import grouping, joining, shaping, windows
from .plans import events, models

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


r2 = lambda c: F.round(c, 2)


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def filter_project(t):
    f = Frame(t("lineitem"))
    f = f[(f["l_quantity"] > 45) & (f["l_returnflag"] == "R")]
    return f.assign(net=lambda f: F.round(f["l_extendedprice"] * (1 - f["l_discount"]), 4))[["l_orderkey", "l_linenumber", "net"]].df


@query("SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 25")
def topk_orders(t):
    f = Frame(t("orders")).sort_values(["o_totalprice", "o_orderkey"], [False, True])[0:25]
    return f.df.select("o_orderkey", r2(F.col("o_totalprice")).alias("o_totalprice"))


@query("SELECT o_orderkey, CAST(floor((o_custkey - 700) / 7.0) AS BIGINT) AS fd, CAST((o_custkey - 700) - floor((o_custkey - 700) / 7.0) * 7 AS BIGINT) AS md FROM orders")
def floordiv_mod(t):
    a, b = F.col("o_custkey") - 700, F.lit(7)
    return t("orders").select("o_orderkey", scalars.floordiv(a, b).alias("fd"), scalars.mod(a, b).cast("long").alias("md"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity_sum, round(avg(l_discount), 6) AS l_discount_mean, count(l_orderkey) AS l_orderkey_count FROM lineitem GROUP BY 1, 2")
def pricing_summary(t):
    f = Frame(t("lineitem")).groupby(["l_returnflag", "l_linestatus"]).agg({"l_quantity": "sum", "l_discount": "mean", "l_orderkey": "count"})
    return f.df.withColumn("l_quantity_sum", r2(F.col("l_quantity_sum"))).withColumn("l_discount_mean", F.round("l_discount_mean", 6))


@query("SELECT o_custkey, count(o_orderkey) AS o_orderkey_count FROM orders GROUP BY 1 HAVING count(o_orderkey) > 15")
def having_orders(t):
    return Frame(t("orders")).groupby("o_custkey").having({"o_orderkey": "count"}, F.col("o_orderkey_count") > 15).df


@query("SELECT c_mktsegment, c_nationkey, count(c_custkey) AS c_custkey_count FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def rollup_segment(t):
    return Frame(t("customer")).rollup(["c_mktsegment", "c_nationkey"], {"c_custkey": "count"}).df


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity_sum FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_flags(t):
    return Frame(t("lineitem")).cube(["l_returnflag", "l_linestatus"], {"l_quantity": "sum"}).df.withColumn("l_quantity_sum", r2(F.col("l_quantity_sum")))


@query("SELECT l_returnflag, l_linestatus, count(l_orderkey) AS l_orderkey_count FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(t):
    return Frame(t("lineitem")).grouping_sets([["l_returnflag"], ["l_linestatus"], []], {"l_orderkey": "count"}).df


@query("SELECT o_orderpriority, quantile_disc(o_orderstatus, 0.5) AS o_orderstatus_median FROM orders GROUP BY 1")
def median_of_text(t):
    return Frame(t("orders")).groupby("o_orderpriority").agg({"o_orderstatus": "median"}).df


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.9), 4) AS q90 FROM lineitem GROUP BY 1")
def quantiles(t):
    q = grouping.quantiles_by(t("lineitem"), ["l_returnflag"], ["l_extendedprice"], [0.25, 0.9]).withColumnRenamed("l_extendedprice", "q")
    return q.select("l_returnflag", F.round(F.col("q")[0], 4).alias("q25"), F.round(F.col("q")[1], 4).alias("q90"))


@query("SELECT c_nationkey, min(c_mktsegment) AS c_mktsegment_mode FROM (SELECT c_nationkey, c_mktsegment, rank() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC) AS r FROM customer GROUP BY 1, 2) WHERE r = 1 GROUP BY 1")
def mode_smallest(t):
    return Frame(t("customer")).groupby("c_nationkey").agg({"c_mktsegment": "mode"}).df


@query("SELECT l_returnflag, round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 6) AS l_quantity_sem, round(var_samp(l_quantity), 6) AS l_quantity_var, round(stddev_samp(l_quantity), 6) AS l_quantity_std, count(DISTINCT l_suppkey) AS l_suppkey_nunique FROM lineitem GROUP BY 1")
def spread(t):
    f = Frame(t("lineitem")).groupby("l_returnflag").agg({"l_quantity": ["sem", "var", "std"], "l_suppkey": "nunique"})
    return f.df.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("l_quantity_sem", "l_quantity_var", "l_quantity_std")], "l_suppkey_nunique")


def _nation(t):
    return Frame(t("nation"))[["n_nationkey", "n_name"]].rename({"n_nationkey": "c_nationkey"})


@query("SELECT c_custkey, c.c_nationkey, n_name FROM customer c JOIN nation ON n_nationkey = c_nationkey")
def merge_inner(t):
    return Frame(t("customer"))[["c_custkey", "c_nationkey"]].merge(_nation(t), on="c_nationkey").df


@query("SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON n_nationkey = c_nationkey")
def merge_left(t):
    n = Frame(t("nation").where("n_regionkey = 1"))[["n_nationkey", "n_name"]].rename({"n_nationkey": "c_nationkey"})
    return Frame(t("customer"))[["c_custkey", "c_nationkey"]].merge(n, "left", on="c_nationkey").df


@query("SELECT coalesce(c_custkey, o_custkey) AS k, c_name, o_orderkey FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') FULL JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON c_custkey = o_custkey")
def merge_outer_coalesces_keys(t):
    c = t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"), "c_name")
    o = t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return joining.merge(c, o, "outer", on=["k"])


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def merge_cross(t):
    return joining.merge(t("region").select("r_name"), t("nation").select("n_name"), "cross")


@query("SELECT a.n_name AS n_name_x, b.n_name AS n_name_y, a.n_regionkey AS n_regionkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def merge_theta(t):
    n = t("nation")
    out = joining.merge(n, n, on=["n_regionkey"], condition=lambda x, y: x("n_nationkey") < y("n_nationkey"))
    return out.select("n_name_x", "n_name_y", "n_regionkey")


@query("SELECT CAST(o_orderkey AS DOUBLE) AS k, o_orderstatus AS s FROM orders UNION ALL SELECT c_acctbal, NULL FROM customer")
def append_mixed(t):
    a = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return joining.append([a, t("customer").select(F.col("c_acctbal").alias("k"))])


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def isin_subquery(t):
    return joining.isin(t("orders"), "o_custkey", t("customer").where("c_acctbal > 9000").select("c_custkey")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > ALL (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'P')")
def compare_all(t):
    o = t("orders")
    return joining.compare_all(o, "o_totalprice", ">", o.where("o_orderstatus = 'P'").select("o_totalprice")).select("o_orderkey")


@query("SELECT event_id, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(ntile(4) OVER w AS BIGINT) AS nt, lag(value) OVER w AS lg, lead(value, 2) OVER w AS ld FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_family(t):
    w = windows.window(["user_id"], ["ts", "event_id"])
    return t("events").select("event_id", F.row_number().over(w).cast("long").alias("rn"), F.ntile(4).over(w).cast("long").alias("nt"), F.lag("value").over(w).alias("lg"), F.lead("value", 2).over(w).alias("ld"))


@query("SELECT c_custkey, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)")
def rank_family(t):
    w = windows.window(["c_nationkey"], ["c_mktsegment"])
    return t("customer").select("c_custkey", F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dr"), F.round(F.percent_rank().over(w), 8).alias("pr"), F.round(F.cume_dist().over(w), 8).alias("cd"))


@query("SELECT event_id, CASE WHEN count(*) OVER w >= 3 THEN round(avg(value) OVER w, 6) END AS m, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)")
def rolling_and_expanding(t):
    w = windows.window(["user_id"], ["ts", "event_id"])
    return t("events").select("event_id", F.round(windows.rolling(F.avg("value"), w, 5, 3), 6).alias("m"), F.round(windows.expanding(F.sum("value"), w), 4).alias("s"))


@query("SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)")
def fills(t):
    e = t("events").withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    w = windows.window(["user_id"], ["ts", "event_id"])
    return e.select("event_id", windows.ffill(F.col("v"), w).alias("f"), windows.bfill(F.col("v"), w).alias("b"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def drop_duplicates_last(t):
    return Frame(t("orders")).drop_duplicates(["o_custkey"], "last", ["o_orderdate", "o_orderkey"]).df.select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderpriority) = 1")
def drop_duplicates_none(t):
    return Frame(t("orders")).drop_duplicates(["o_custkey", "o_orderpriority"], False).df.select("o_custkey", "o_orderkey")


@query("SELECT c_custkey, c_name[2:5] AS a, c_name[-3:] AS b, c_name[:-5] AS c, replace(c_name, '0', '-') AS d FROM customer")
def string_slices(t):
    n = F.col("c_name")
    return t("customer").select("c_custkey", scalars.str_slice(n, 1, 5).alias("a"), scalars.str_slice(n, -3).alias("b"), scalars.str_slice(n, None, -4).alias("c"), scalars.str_replace(n, "0", "-").alias("d"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS a, strftime(ts, '%j %B %b %y') AS b, strftime(ts, '%G-%V-%u') AS c FROM events")
def strftime_codes(t):
    ts = F.col("ts")
    return t("events").select("event_id", temporal.strftime(ts, "%Y-%m-%d %H:%M:%S.%f").alias("a"), temporal.strftime(ts, "%j %B %b %y").alias("b"), temporal.strftime(ts, "%G-%V-%u").alias("c"))


@query("SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS w, count(*) AS n FROM events GROUP BY 1")
def date_trunc_week(t):
    return t("events").groupBy(F.date_format(temporal.date_trunc("week", F.col("ts")), "yyyy-MM-dd").alias("w")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(floor(us / 86400000000) AS BIGINT) AS days, CAST(floor((us - floor(us / 86400000000) * 86400000000) / 3600000000) AS BIGINT) AS hours, round(us / 1e6, 6) AS total FROM (SELECT event_id, date_diff('microsecond', TIMESTAMP '2024-01-15 12:00:00', ts) AS us FROM events)")
def timedelta_parts(t):
    d = F.col("ts") - F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    c = temporal.components(d)
    return t("events").select("event_id", c["days"].alias("days"), c["hours"].alias("hours"), F.round(temporal.total_seconds(d), 6).alias("total"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_key(t):
    return t("events").select("event_id", scalars.json_value(F.col("props"), "k", True).cast("long").alias("k"))


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def list_items(t):
    return t("embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query("SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS \"F__o_orderkey\", max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS \"O__o_orderkey\", max(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS \"P__o_orderkey\" FROM orders GROUP BY 1")
def unstack(t):
    f = Frame(t("orders").select("o_custkey", "o_orderstatus", "o_orderkey"), ("o_custkey", "o_orderstatus"))
    return f.unstack(["F", "O", "P"]).df


@query("SELECT s_suppkey, 's_acctbal' AS __stacked_index, round(s_acctbal, 2) AS __stacked FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey', s_nationkey FROM supplier")
def stack(t):
    s = t("supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("s_nationkey"))
    return Frame(s, ("s_suppkey",)).stack().df.withColumn("__stacked", r2(F.col("__stacked")))


_CUT = """WITH p AS (SELECT min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS b FROM part), e AS (SELECT i, a + (b - a) / 5 * i - CASE WHEN i = 0 THEN (b - a) * 0.001 ELSE 0 END AS x FROM p, range(6) r(i))
SELECT p_partkey, round(l.x, 6) AS lower, round(u.x, 6) AS upper FROM part JOIN e l ON p_size > l.x JOIN e u ON u.i = l.i + 1 AND (p_size <= u.x OR u.i = 5)"""


@query(_CUT)
def cut_bins(t):
    out = shaping.cut(t("part").select("p_partkey", "p_size"), "p_size", 5)
    return out.select("p_partkey", F.round("range.lower", 6).alias("lower"), F.round("range.upper", 6).alias("upper"))


@query("WITH q AS (SELECT quantile_cont(o_totalprice, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM orders) SELECT round(CASE WHEN k = 1 THEN e[1] - 0.001 ELSE e[k] END, 3) AS lower, count(*) AS n FROM orders, q, range(1, 5) r(k) WHERE o_totalprice > CASE WHEN k = 1 THEN e[1] - 0.001 ELSE e[k] END AND o_totalprice <= e[k + 1] GROUP BY 1")
def qcut_bins(t):
    out = shaping.qcut(t("orders").select("o_totalprice"), "o_totalprice", 4)
    return out.groupBy(F.round("q_range.lower", 3).alias("lower")).agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, round(count(*) / sum(count(*)) OVER (), 8) AS value_counts FROM customer GROUP BY 1")
def value_counts(t):
    return Frame(t("customer").select("c_mktsegment")).value_counts(normalize=True).df.select("c_mktsegment", F.round("value_counts", 8).alias("value_counts"))


@query("SELECT s_suppkey, round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER (), 6) AS a, round((s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()), 6) AS b FROM supplier")
def scalers(t):
    s = t("supplier").select("s_suppkey", F.col("s_acctbal").alias("a"), F.col("s_acctbal").alias("b"))
    return Frame(s).scale(["a"]).minmax_scale(["b"]).df.select("s_suppkey", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("SELECT c_custkey, (c_mktsegment = 'BUILDING')::BIGINT AS seg_BUILDING, (c_mktsegment = 'MACHINERY')::BIGINT AS seg_MACHINERY FROM customer")
def dummies(t):
    return Frame(t("customer").select("c_custkey", "c_mktsegment")).get_dummies("c_mktsegment", values=["BUILDING", "MACHINERY"], prefix="seg").df


@query("""SELECT * FROM (SELECT 'count' AS __stat, round(count(p_retailprice)::DOUBLE, 2) AS p_retailprice FROM part UNION ALL SELECT 'mean', round(avg(p_retailprice), 2) FROM part UNION ALL SELECT 'std', round(stddev_samp(p_retailprice), 2) FROM part
UNION ALL SELECT 'min', round(min(p_retailprice), 2) FROM part UNION ALL SELECT 'max', round(max(p_retailprice), 2) FROM part UNION ALL SELECT 'nunique', count(DISTINCT p_retailprice)::DOUBLE FROM part UNION ALL SELECT '0.5', round(quantile_cont(p_retailprice, 0.5), 2) FROM part UNION ALL SELECT 'mode', round(min(v), 2) FROM (SELECT p_retailprice AS v, rank() OVER (ORDER BY count(*) DESC) AS r FROM part GROUP BY 1) WHERE r = 1)""")
def describe(t):
    return Frame(t("part").select("p_retailprice")).describe([0.5]).df


# Events

_SESSIONS = """WITH a AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) <= 1800000000 THEN 0 ELSE 1 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM a), c AS (SELECT user_id, k, row_number() OVER (ORDER BY ts, event_id) AS session_id FROM b WHERE st = 1),
s AS (SELECT b.event_id, b.user_id, b.ts AS moment, b.event_type, b.value, c.session_id, row_number() OVER (PARTITION BY c.session_id ORDER BY b.ts, b.event_id) AS session_hit_number FROM b JOIN c USING (user_id, k)) """


def _sessions(t):
    e = t("events").select("event_id", "user_id", F.col("ts").alias("moment"), "event_type", "value")
    return events.sessionize(e)


@query(_SESSIONS + "SELECT event_id, user_id, session_id, session_hit_number FROM s")
def sessionize(t):
    return _sessions(t).select("event_id", "user_id", "session_id", "session_hit_number")


@query(_SESSIONS + "SELECT strftime(moment, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS unique_users, count(DISTINCT session_id) AS unique_sessions FROM s GROUP BY 1")
def daily_users_and_sessions(t):
    s = _sessions(t).withColumn("day", models.time_agg(F.col("moment"), "%Y-%m-%d"))
    return s.groupBy("day").agg(F.count_distinct("user_id").alias("unique_users"), F.count_distinct("session_id").alias("unique_sessions"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS unique_users FROM events GROUP BY 1")
def unique_users(t):
    e = t("events").withColumn("day", models.time_agg(F.col("ts"), "%Y-%m-%d"))
    return models.unique_users(e, ["day"])


@query(_SESSIONS + "SELECT event_type, round(avg(d), 4) AS session_duration FROM (SELECT event_type, session_id, date_diff('microsecond', min(moment), max(moment)) / 1e6 AS d FROM s GROUP BY 1, 2) WHERE d > 0 GROUP BY 1")
def session_duration(t):
    return models.session_duration(_sessions(t), ["event_type"]).withColumn("session_duration", F.round("session_duration", 4))


@query(_SESSIONS + "SELECT session_id, count(DISTINCT user_id) AS unique_users FROM (SELECT user_id, count(DISTINCT session_id) AS session_id FROM s GROUP BY 1) GROUP BY 1")
def frequency(t):
    return models.frequency(_sessions(t))


@query(_SESSIONS + "SELECT event_id, session_id = min(session_id) OVER (PARTITION BY user_id) AS first_session, min(session_id) OVER (PARTITION BY user_id, strftime(moment, '%Y-%m-%d')) = min(session_id) OVER (PARTITION BY user_id) AS new_user FROM s")
def first_sessions(t):
    s = _sessions(t)
    return s.select("event_id", models.is_first_session().alias("first_session"), models.is_new_user(models.time_agg(F.col("moment"), "%Y-%m-%d")).alias("new_user"))


@query(_SESSIONS + "SELECT event_id, CAST(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY moment) AS BIGINT) AS in_time, CAST(sum((event_type = 'purchase')::INT) OVER (PARTITION BY session_id) AS BIGINT) AS counter FROM s")
def conversions(t):
    hit = F.col("event_type") == "purchase"
    return _sessions(t).select("event_id", models.conversions_in_time(hit, "user_id").alias("in_time"), models.conversions_counter(hit).alias("counter"))


@query(_SESSIONS + """, c2 AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY session_id) > 0 AND sum((event_type = 'purchase')::INT) OVER (PARTITION BY session_id ORDER BY moment) = 0 AS pre FROM s)
SELECT event_id, CASE WHEN pre THEN CAST(sum(pre::INT) OVER (PARTITION BY session_id ORDER BY session_hit_number DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS pre_conversion_hit_number FROM c2""")
def pre_conversion_hits(t):
    return models.pre_conversion_hits(_sessions(t), F.col("event_type") == "purchase").select("event_id", "pre_conversion_hit_number")


def _retention(part: str) -> str:
    counts = ", ".join(f"nullif(count(*) FILTER (d = {k}), 0) AS _{k}" for k in range(4))
    return f"WITH p AS (SELECT DISTINCT user_id, date_trunc('{part}', ts) AS p FROM events), f AS (SELECT *, min(p) OVER (PARTITION BY user_id) AS f FROM p), g AS (SELECT *, date_diff('{part}', f, p) AS d FROM f) SELECT strftime(f, '%Y-%m-%d') AS first_cohort, {counts} FROM g GROUP BY 1"


def _with_moment(t):
    return t("events").withColumnRenamed("ts", "moment")


@query(_retention("day"))
def retention_daily(t):
    return models.retention_matrix(_with_moment(t), "daily")


@query(_retention("week"))
def retention_weekly(t):
    return models.retention_matrix(_with_moment(t), "weekly")


@query("SELECT event_type, count(DISTINCT user_id) AS unique_users FROM events GROUP BY 1")
def top_features(t):
    return models.top_features(t("events"), ["event_type"])


@query()
def logistic_regression(t):
    rows = t("orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int")).withColumn("x", F.col("o_totalprice") / 1e5)
    model = models.LogisticRegression().fit(rows, ["x"], "y")
    return rows.select("o_orderkey", F.round(model.predict_proba(), 6).alias("p"))


from . import queries_more  # noqa: E402, F401  registers its queries here


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["daily_users_and_sessions"](spark, sf_dir).orderBy("day")
