"""More registered queries: series, labels, subqueries, JSON, spans, windows, events with contexts, ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from .frame import Frame
from .operators import joining, shaping, windows
from .plans import events, models
from .plans.event_models import EventModels
from .queries import _SESSIONS, _sessions, query
from .series import Series
from .streaming import ingest
from .streaming.schema import EventSchema, Hierarchy

# Series


@query("""SELECT o_orderkey, o_orderkey + o_custkey AS a, o_orderkey - o_custkey AS s, o_orderkey * 2 AS m, round(o_orderkey / 7.0, 6) AS d, CAST(floor((o_custkey - 700) / 7.0) AS BIGINT) AS fd, CAST(((o_custkey - 700) % 7 + 7) % 7 AS BIGINT) AS md,
CAST(floor((o_custkey - 700) / -7.0) AS BIGINT) AS fn, CAST(o_custkey * o_custkey AS DOUBLE) AS p, CAST(o_custkey * 4 AS BIGINT) AS l, CAST(o_custkey // 2 AS BIGINT) AS r, (o_orderkey * 10000000000001) // 7 AS big FROM orders""")
def series_arithmetic(t):
    f = Frame(t("orders"))
    k, c = f.o_orderkey, f.o_custkey
    out = f.assign(a=k + c, s=k - c, m=k * 2, d=(k / 7).round(6), fd=(c - 700) // 7, md=(c - 700) % 7, fn=(c - 700) // -7, p=c**2, l=c << 2, r=c >> 1, big=(k * 10_000_000_000_001) // 7)
    return out[["o_orderkey", "a", "s", "m", "d", "fd", "md", "fn", "p", "l", "r", "big"]].df


@query("""SELECT o_orderkey, p = s AS e, p <> s AS n, p < s AS l, p <= s AS le, p > s AS g, p >= s AS ge, (p > 5) AND (s > 5) AS a, (p > 5) OR (s > 5) AS o, (p > 5) <> (s > 5) AS x, NOT (p > 5) AS i, s IS NULL AS isn, s IS NOT NULL AS non, coalesce(s, -1) AS f
FROM (SELECT o_orderkey, o_custkey % 10 AS p, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 10 END AS s FROM orders)""")
def series_comparisons(t):
    f = Frame(t("orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("p"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 10).alias("s")))
    p, s = f.p, f.s
    out = f.assign(e=p == s, n=p != s, l=p < s, le=p <= s, g=p > s, ge=p >= s, a=(p > 5) & (s > 5), o=(p > 5) | (s > 5), x=(p > 5) ^ (s > 5), i=~(p > 5), isn=s.isnull(), non=s.notnull(), f=s.fillna(-1))
    return out.df.drop("p", "s")


_AGGREGATES = {
    "count": "count({c})", "min": "min({c})", "max": "max({c})", "sum": "round(sum({c}), 4)", "mean": "round(avg({c}), 6)", "median": "quantile_disc({c}, 0.5)", "nunique": "count(DISTINCT {c})",
    "std": "round(stddev_samp({c}), 6)", "std_pop": "round(stddev_pop({c}), 6)", "var": "round(var_samp({c}), 6)", "sem": "round(stddev_samp({c}) / sqrt(count({c})), 6)",
}


def _frame_aggregate(name: str, sql: str) -> None:
    parts = ", ".join(f"CAST({sql.format(c=c)} AS DOUBLE) AS {c}_{name}" for c in ("l_quantity", "l_extendedprice"))

    def run(t):
        f = Frame(t("lineitem").select("l_shipdate", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")).groupby(["l_returnflag", "l_linestatus"])
        out = getattr(f, name)(numeric_only=True).df
        return out.select("l_returnflag", "l_linestatus", *[F.round(F.col(c).cast("double"), 4 if name == "sum" else 6).alias(c) for c in out.columns if c.endswith(f"_{name}")])

    run.__name__ = f"frame_{name}"
    query(f"SELECT l_returnflag, l_linestatus, {parts} FROM lineitem GROUP BY ALL")(run)


for _name, _sql in _AGGREGATES.items():
    _frame_aggregate(_name, _sql)


@query("SELECT * FROM (SELECT c_nationkey, c_mktsegment AS c_mktsegment_mode FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1, 2) WHERE r = 1)")
def frame_mode(t):
    return Frame(t("customer").select("c_nationkey", "c_mktsegment")).groupby("c_nationkey").mode().df


@query("SELECT o_custkey, CASE WHEN count(o_totalprice) >= 12 THEN round(sum(o_totalprice), 2) END AS o_totalprice_sum FROM orders GROUP BY 1")
def sum_of_enough(t):
    out = Frame(t("orders").select("o_custkey", "o_totalprice")).groupby("o_custkey").sum(min_count=12)
    return out.df.select("o_custkey", F.round("o_totalprice_sum", 2).alias("o_totalprice_sum"))


@query("""SELECT r_regionkey, n, lo, hi, s, a, med, u, sd, sp, v, e, mo, q, ex FROM region, (SELECT count(o_totalprice) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, quantile_disc(o_totalprice, 0.5) AS med, count(DISTINCT o_custkey) AS u,
round(stddev_samp(o_totalprice), 4) AS sd, round(stddev_pop(o_totalprice), 4) AS sp, round(var_samp(o_totalprice), 2) AS v, round(stddev_samp(o_totalprice) / sqrt(count(*)), 6) AS e, round(quantile_cont(o_totalprice, 0.25), 4) AS q, count(*) > 0 AS ex FROM orders),
(SELECT o_orderpriority AS mo FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""")
def series_values(t):
    o = Frame(t("orders"))
    p = o.o_totalprice
    one = {"n": p.count(), "lo": p.min(), "hi": p.max(), "s": p.sum().round(2), "a": p.mean().round(4), "med": p.median(), "u": o.o_custkey.nunique(), "sd": p.std().round(4), "sp": p.std_pop().round(4), "v": p.var().round(2), "e": p.sem().round(6), "mo": o.o_orderpriority.mode(), "q": p.quantile(0.25).round(4), "ex": p.exists()}
    return Frame(t("region").select("r_regionkey")).assign(**one).df


@query("SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS low, bool_or(o_totalprice > 400000) AS high FROM orders GROUP BY 1")
def bool_extremes(t):
    f = Frame(t("orders")).groupby("o_orderstatus")
    low, high = (f.o_totalprice > 1000).min(), (f.o_totalprice > 400000).max()
    return low.frame.merge(high.frame.rename({high.name: "high"}), on="o_orderstatus").df.select("o_orderstatus", F.col(low.name).alias("low"), "high")


@query("SELECT c_custkey, c_name, n AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def assign_by_index(t):
    n = Frame(t("orders")).groupby("o_custkey").agg({"o_orderkey": "count"}).rename({"o_custkey": "c_custkey"})
    return Frame(t("customer").select("c_custkey", "c_name"), ("c_custkey",)).assign(orders=n.o_orderkey_count).df


@query("SELECT DISTINCT o_orderpriority FROM orders")
def series_unique(t):
    return Frame(t("orders")).o_orderpriority.unique().frame.df


@query("SELECT o_orderpriority, count(*) AS value_counts FROM orders GROUP BY 1")
def series_value_counts(t):
    return Frame(t("orders")).o_orderpriority.value_counts().df


@query("SELECT c_name AS x FROM customer UNION ALL SELECT s_name FROM supplier")
def series_append(t):
    return Frame(t("customer")).c_name.append(Frame(t("supplier")).s_name).frame.rename({"c_name": "x"}).df


@query("SELECT p_partkey, p_brand || '-' || p_type AS j, p_name[1:4] AS h, p_name[-2:] AS e, replace(p_name, 'a', '_') AS r FROM part")
def series_text(t):
    f = Frame(t("part"))
    return f.assign(j=f.p_brand + "-" + f.p_type, h=f.p_name.str[0:4], e=f.p_name.str[-2:], r=f.p_name.str.replace("a", "_"))[["p_partkey", "j", "h", "e", "r"]].df


@query("SELECT p_partkey, round(exp(p_size / 100.0), 6) AS e, CAST(round(p_retailprice) AS BIGINT) AS i, p_size <> 0 AS b, CAST(p_size AS DOUBLE) AS f, CAST(p_size AS VARCHAR) AS s FROM part")
def series_conversions(t):
    f = Frame(t("part"))
    out = f.assign(e=(f.p_size / 100).exp().round(6), i=f.p_retailprice.astype("int64"), b=f.p_size.astype("bool"), f=f.p_size.astype("float64"), s=f.p_size.astype("string"))
    return out[["p_partkey", "e", "i", "b", "f", "s"]].df


@query("SELECT p_partkey, round(CAST(p_retailprice AS DECIMAL(28, 12)), 1)::DOUBLE AS p_retailprice FROM part")
def round_frame(t):
    return Frame(t("part").select("p_partkey", "p_retailprice")).round(1).df


@query("SELECT o_orderkey, lower(u) AS u, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE lower(u) END AS v, lower(u) = u AS same FROM (SELECT o_orderkey, upper(substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21)) AS u FROM (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS m FROM orders))")
def series_uuid(t):
    m = F.md5(F.col("o_orderkey").cast("string"))
    text = F.upper(F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
    f = Frame(t("orders").select("o_orderkey", text.alias("t"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(text, F.lit("x"))).otherwise(text).alias("w")))
    return f.assign(u=f.t.astype("uuid"), v=f.w.astype("uuid")).assign(same=lambda g: g.u == g.t)[["o_orderkey", "u", "v", "same"]].df


# Labels, subqueries, samples, variables


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 5, 7, 12)")
def loc_labels(t):
    return Frame(t("customer"), ("c_custkey",)).loc[[1, 5, 7, 12], ["c_name"]].df


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_custkey BETWEEN 10 AND 90")
def loc_slice(t):
    return Frame(t("customer"), ("c_custkey",)).loc[10:90, "c_nationkey":"c_acctbal"].df


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey >= 100 THEN 'late' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def loc_set(t):
    f = Frame(t("customer").select("c_custkey", "c_acctbal", "c_mktsegment"), ("c_custkey",))
    f = f.loc.set(f["c_acctbal"] < 0, "c_acctbal", 0.0)
    return f.loc.set(slice(100, None), "c_mktsegment", "late").df


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > ALL (SELECT p_retailprice FROM part WHERE p_size < 0)")
def compare_all_of_none(t):
    return joining.compare_all(t("orders"), "o_totalprice", ">", t("part").where("p_size < 0").select("p_retailprice")).select("o_orderkey")


@query("""WITH b AS (SELECT CASE WHEN p_size > 10 THEN p_retailprice END AS v FROM part) SELECT o_orderkey, o_totalprice > ALL (SELECT v FROM b) AS al, o_totalprice > ANY (SELECT v FROM b) AS an, o_totalprice < ALL (SELECT v FROM b WHERE v IS NOT NULL) AS lo,
o_totalprice <> ANY (SELECT v FROM b WHERE v IS NOT NULL) AS ne, o_totalprice = ALL (SELECT v FROM b WHERE v < 0) AS eq FROM orders""")
def subquery_truth(t):
    f = Frame(t("orders"))
    b = Frame(t("part").select(F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("v")))
    known, none = b[b["v"].isNotNull()].v, b[b["v"] < 0].v
    p = f.o_totalprice
    out = f.assign(al=b.v.all_values().compare(p, ">"), an=b.v.any_value().compare(p, ">"), lo=known.all_values().compare(p, "<"), ne=known.any_value().compare(p, "<>"), eq=none.all_values().compare(p, "="))
    return out[["o_orderkey", "al", "an", "lo", "ne", "eq"]].df


@query("SELECT l_returnflag, round(sum(x), 3) AS x_sum FROM (SELECT l_returnflag, (l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()) AS x FROM lineitem) GROUP BY 1")
def unsampled(t):
    f = Frame(t("lineitem").select("l_returnflag", F.col("l_quantity").alias("x"))).sample(10, 3)
    out = f.minmax_scale(["x"]).sort_values("l_returnflag").groupby("l_returnflag").agg({"x": "sum"}).unsampled()
    return out.df.select("l_returnflag", F.round("x_sum", 3).alias("x_sum"))


@query("SELECT l_returnflag, count(l_orderkey) AS l_orderkey_count FROM lineitem WHERE l_quantity > 30 GROUP BY 1")
def variables(t):
    f, least = Frame(t("lineitem")).create_variable("least", 10)
    out = f[f["l_quantity"] > least].groupby("l_returnflag").agg({"l_orderkey": "count"})
    return out.set_variable("least", 30).to_spark()


@query("SELECT c_custkey, round((c_acctbal - m) / s, 6) AS a FROM customer, (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS s FROM supplier)")
def fitted_scaler(t):
    scaler = Frame(t("supplier").select(F.col("s_acctbal").alias("a"))).fit_scaler(["a"])
    return Frame(t("customer").select("c_custkey", F.col("c_acctbal").alias("a"))).transform(scaler).df.select("c_custkey", F.round("a", 6).alias("a"))


@query("SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::BIGINT AS seg_{s}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def dummies_of_all_values(t):
    out = Frame(t("customer").select("c_custkey", "c_mktsegment")).get_dummies("c_mktsegment", prefix="seg").df
    return out.withColumns({f"seg_{s}": F.lit(0).cast("long") for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY") if f"seg_{s}" not in out.columns})


@query("WITH e AS (SELECT min(p_size)::DOUBLE AS a, (max(p_size) - min(p_size)) / 7.0 AS w FROM part), b AS (SELECT k, a + w * k AS lower, a + w * (k + 1) AS upper FROM e, range(7) r(k)), x AS (SELECT greatest(0, least(6, ceil((p_size - a) / w) - 1))::BIGINT AS k, count(*) AS n FROM part, e GROUP BY 1) SELECT round(lower, 6) AS lower, round(upper, 6) AS upper, coalesce(n, 0) AS p_size FROM b LEFT JOIN x USING (k)")
def histogram(t):
    return Frame(t("part").select("p_size")).hist(["p_size"], 7).df.select(F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "p_size")


# Windows


@query("""SELECT event_id, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd, CAST(ntile(3) OVER w AS BIGINT) AS nt, lag(value) OVER w AS lg, lead(value, 2) OVER w AS ld,
first_value(value) OVER w AS fv, last_value(value) OVER w AS lv, nth_value(value, 3) OVER w AS nv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def series_windows(t):
    f = Frame(t("events")).groupby("user_id").sort_values(["ts", "event_id"])
    v = f.value
    made = {"rn": v.window_row_number(), "rk": v.window_rank(), "dr": v.window_dense_rank(), "pr": v.window_percent_rank().round(8), "cd": v.window_cume_dist().round(8), "nt": v.window_ntile(3), "lg": v.window_lag(), "ld": v.window_lead(2), "fv": v.window_first_value(), "lv": v.window_last_value(), "nv": v.window_nth_value(3)}
    df = f.assign(**made).df
    return df.select("event_id", *[F.col(c).cast("long").alias(c) if c in ("rn", "rk", "dr", "nt") else c for c in made])


@query("SELECT c_custkey, round(sum(c_acctbal) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s, count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey ROWS BETWEEN 1 PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM customer")
def window_frames(t):
    s = windows.framed(F.sum("c_acctbal"), windows.window(["c_mktsegment"], ["c_nationkey"]), -2, 1, "range")
    n = windows.framed(F.count("*"), windows.window(["c_mktsegment"], ["c_custkey"]), -1, None)
    return t("customer").select("c_custkey", F.round(s, 2).alias("s"), n.alias("n"))


# Dates and spans


@query("""SELECT event_id, strftime(ts, '%a %A %d %m') AS a, strftime(ts, '%H:%M %I') AS r, strftime(ts, '%m/%d/%y') AS d, strftime(ts, '%Y-%m-%d') AS f, strftime(ts, '%H:%M:%S') AS t, 'Q' || quarter(ts) AS q, (dayofweek(ts) + 1)::VARCHAR AS w, '21' AS c, substr(strftime(ts, '%G'), 3) AS g, strftime(ts, '%b') AS h FROM events""")
def strftime_rest(t):
    f = Frame(t("events"))
    s = f.ts.dt
    return f.assign(a=s.strftime("%a %A %d %m"), r=s.strftime("%R %I"), d=s.strftime("%D"), f=s.strftime("%F"), t=s.strftime("%T"), q=s.strftime("Q%Q"), w=s.strftime("%w"), c=s.strftime("%C"), g=s.strftime("%g"), h=s.strftime("%h"))[["event_id", *"ardftqwcgh"]].df


@query("""SELECT event_id, CAST(strftime(d + INTERVAL 2 DAY, '%Y-%m-%d') AS VARCHAR) AS plus, strftime(d - INTERVAL 1 DAY, '%Y-%m-%d') AS minus, CAST(date_diff('day', DATE '2024-01-01', d) * 86400.0 AS DOUBLE) AS since, CAST(event_id % 90 AS DOUBLE) + 0.5 + 3600 * 26 AS span, ((event_id % 90) * 2.0 + 1.0 + 7200 * 26)::DOUBLE AS twice, (((event_id % 90) + 0.5 + 3600 * 26) / 4)::DOUBLE AS quarter
FROM (SELECT event_id, ts::DATE AS d FROM events)""")
def dates_and_spans(t):
    span = F.concat(F.lit("P1DT2H"), (F.col("event_id") % 90).cast("string"), F.lit(".5S"))
    f = Frame(t("events").select("event_id", F.col("ts").cast("date").alias("d"), F.lit("2024-01-01").cast("date").alias("z"), span.alias("p")))
    s = f.p.astype("timedelta")
    out = f.assign(plus=(f.d + F.expr("interval '36' hour")).dt.strftime("%F"), minus=(f.d - F.expr("interval '25' hour")).dt.strftime("%F"), since=(f.d - f.z).dt.total_seconds, span=s.dt.total_seconds, twice=(s + s).dt.total_seconds, quarter=(s / 4).dt.total_seconds)
    return out[["event_id", "plus", "minus", "since", "span", "twice", "quarter"]].df


@query("SELECT event_type, round(sum(us) / 1e6, 3) AS s, round(avg(us) / 1e6, 3) AS m, round(quantile_cont(us, 0.25) / 1e6, 3) AS q, round(min(us) / 1e6, 3) AS lo FROM (SELECT event_type, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) AS us FROM events) GROUP BY 1")
def span_aggregates(t):
    f = Frame(t("events").select("event_type", (F.col("ts") - F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("x"))).groupby("event_type")
    parts = {"s": f.x.sum(), "m": f.x.mean(), "q": f.x.quantile(0.25), "lo": f.x.min()}
    out = None
    for k, s in parts.items():
        one = s.frame.df.select("event_type", F.round(s.dt.total_seconds.column, 3).alias(k))
        out = one if out is None else joining.merge(out, one, on=["event_type"])
    return out


@query("SELECT event_id, CAST(floor(us / 86400000000) AS BIGINT) AS d, CAST(floor((us - floor(us / 86400000000) * 86400000000) / 1000000) AS BIGINT) AS s, us - CAST(floor(us / 1000000) AS BIGINT) * 1000000 AS u FROM (SELECT event_id, date_diff('microsecond', TIMESTAMP '2024-01-15 12:00:00.5', ts) AS us FROM events)")
def span_fields(t):
    f = Frame(t("events").select("event_id", (F.col("ts") - F.lit("2024-01-15 12:00:00.5").cast("timestamp_ntz")).alias("x")))
    return f.assign(d=f.x.dt.days, s=f.x.dt.seconds, u=f.x.dt.microseconds)[["event_id", "d", "s", "u"]].df


# JSON, arrays, structs


def _json(t) -> Frame:
    text = F.concat(F.lit('[{"a": "'), F.col("o_orderstatus"), F.lit('", "n": '), F.col("o_custkey").cast("string"), F.lit('}, {"a": "x"}, {"a": "y", "n": [1, 2]}]'))
    return Frame(t("orders").select("o_orderkey", text.alias("j")), ("o_orderkey",))


@query("""SELECT o_orderkey, '{"a":"' || o_orderstatus || '","n":' || o_custkey || '}' AS first, '{"a":"y","n":[1,2]}' AS last, o_custkey::VARCHAR AS n, '[{"a":"x"},{"a":"y","n":[1,2]}]' AS tail, '[{"a":"x"}]' AS mid, '[]' AS none, 3::BIGINT AS size, '[{"a":"' || o_orderstatus || '","n":' || o_custkey || '},{"a":"x"}]' AS head FROM orders""")
def json_access(t):
    f = _json(t)
    j = f.j.json
    return f.assign(first=j[0], last=j[-1], n=j[0].json.get_value("n", True), tail=j[{"a": "x"}:], mid=j[1:-1], none=j[5:], head=j[: {"a": "x"}], size=j.get_array_length().astype("bigint")).drop(["j"]).df


@query("""SELECT o_orderkey, k AS j_offset, CASE k WHEN 0 THEN '{"a":"' || o_orderstatus || '","n":' || o_custkey || '}' WHEN 1 THEN '{"a":"x"}' ELSE '{"a":"y","n":[1,2]}' END AS j FROM orders, range(3) r(k)""")
def flatten_json(t):
    return _json(t).j.json.flatten_array()[0].frame.df


@query("SELECT o_orderkey, true AS one, o_orderstatus = 'F' AS f, false AS no, NULL AS bad FROM orders")
def json_contains(t):
    f = Frame(t("orders").select("o_orderkey", F.concat(F.lit('[1, "'), F.col("o_orderstatus"), F.lit('", 2.5]')).alias("j"), F.lit("{oops").alias("b")))
    j = f.j.json
    return f.assign(one=j.array_contains(1), f=j.array_contains("F"), no=j.array_contains("1"), bad=f.b.json.get_value("k", True))[["o_orderkey", "one", "f", "no", "bad"]].df


@query("SELECT o_orderkey, o_custkey AS k, 'x' AS s, o_custkey + 1 AS second, 9::BIGINT AS last, 3::BIGINT AS n, o_custkey + 10 AS mid FROM orders")
def lists_and_structs(t):
    f = Frame(t("orders"))
    c = f.o_custkey
    d, a = Series.from_value(f, {"k": c, "s": "x"}, "d"), Series.from_value(f, [c, c + 1, F.lit(9).cast("long")], "a")
    return f.assign(k=d.elements["k"], s=d.elements["s"], second=a.elements[1], last=a.elements[-1], n=a.elements.len(), mid=a.elements[0:2].elements[1] + 9)[["o_orderkey", "k", "s", "second", "last", "n", "mid"]].df


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 25.0 ELSE 0.0 END::DOUBLE AS lower, CASE WHEN p_size > 25 THEN 50.0 ELSE 25.0 END::DOUBLE AS upper, '(]' AS bounds FROM part")
def interval_levels(t):
    size = F.col("p_size")
    made = F.struct(F.when(size > 25, 25.0).otherwise(0.0).alias("lower"), F.when(size > 25, 50.0).otherwise(25.0).alias("upper"), F.lit("(]").alias("bounds")).cast(shaping.BIN)
    return Frame(t("part").select("p_partkey", made.alias("r")), ("p_partkey",)).r.elements.flatten().df


# Events with contexts


def _raw(t):
    """Events of the table in the form in which they are collected."""
    user = F.col("user_id").cast("string")
    context = lambda kind, i, **more: F.create_map(*[x for k, v in {"_type": F.lit(kind), "id": i, **more}.items() for x in (F.lit(k), v)])
    contexts = F.array(context("ApplicationContext", F.concat(F.lit("app"), (F.col("user_id") % 3).cast("string"))), context("CookieIdContext", user, cookie_id=user), context("HttpContext", F.lit("http"), user_agent=F.concat(F.lit("ua"), (F.col("user_id") % 5).cast("string"))))
    identity = F.when(F.col("user_id") % 4 == 0, F.array(context("IdentityContext", F.lit("email"), value=F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string"))))).otherwise(F.array().cast("array<map<string,string>>"))
    nav = F.when(F.col("event_id") % 3 == 0, F.array(context("NavigationContext", F.lit("nav")))).otherwise(F.array().cast("array<map<string,string>>"))
    stack = F.concat(F.array(context("WebDocumentContext", F.lit("#doc"), url=F.lit("u"))), nav, F.array(context("LinkContext", F.col("event_type"))))
    value = F.to_json(F.struct(F.col("event_type").alias("_type"), F.array(F.col("event_type"), F.when(F.col("event_type") != "view", F.lit("InteractiveEvent")).otherwise(F.lit("NonInteractiveEvent"))).alias("_types"), F.concat(contexts, identity).alias("global_contexts"), stack.alias("location_stack")))
    return t("events").select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("date").alias("day"), F.col("ts").alias("moment"), user.alias("cookie_id"), value.alias("value"))


_NAV = """'{"_type":"NavigationContext","id":"nav"},'"""
_NAME = "'Link: ' || event_type || ' located at Web Document: #doc' || CASE WHEN event_id % 3 = 0 THEN ' => Navigation: nav' ELSE '' END"


@query(f"""SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS user_id, 'app' || user_id % 3 AS app, user_id::VARCHAR AS cookie, 'ua' || user_id % 5 AS agent, event_type, {_NAME} AS name,
CASE WHEN event_id % 3 = 0 THEN '[' || {_NAV} || '{{"_type":"LinkContext","id":"' || event_type || '"}}]' ELSE '[]' END AS nav, '[{{"_type":"WebDocumentContext","id":"#doc"}},' || CASE WHEN event_id % 3 = 0 THEN {_NAV} ELSE '' END || '{{"_type":"LinkContext","id":"' || event_type || '"}}]' AS features FROM events""")
def context_extraction(t):
    df = events.extract_contexts(_raw(t))
    g, s = F.col("global_contexts"), F.col("location_stack")
    return df.select("event_id", "user_id", events.application(g).alias("app"), events.cookie_id(g).alias("cookie"), events.user_agent(g).alias("agent"), "event_type", events.nice_name(s).alias("name"), events.navigation_features(s).alias("nav"), events.feature_stack(s).alias("features"))


_USER = "CASE WHEN user_id % 4 = 0 THEN 'u' || user_id % 40 || '|email' ELSE user_id::VARCHAR END"


@query(f"SELECT event_id::VARCHAR AS event_id, {_USER} AS user_id FROM events")
def identity_resolution(t):
    return events.resolve_identities(events.dedup_events(events.extract_contexts(_raw(t)))).select("event_id", "user_id")


@query(f"""WITH e AS (SELECT *, {_USER} AS u, event_id::VARCHAR AS ev FROM events), a AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) <= 1800000000 THEN 0 ELSE 1 END AS st FROM e WINDOW w AS (PARTITION BY u ORDER BY ts, ev)),
b AS (SELECT *, sum(st) OVER (PARTITION BY u ORDER BY ts, ev ROWS UNBOUNDED PRECEDING) AS k FROM a), c AS (SELECT u, k, row_number() OVER (ORDER BY ts, ev) AS session_id FROM b WHERE st = 1)
SELECT ev AS event_id, CASE WHEN u LIKE '%|%' THEN u END AS user_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, ev) AS session_hit_number FROM b JOIN c USING (u, k)""")
def anonymous_sessions(t):
    out = events.session_frame(_raw(t), resolve=True, anonymous=True)
    events.check_frame(out)
    return out.select("event_id", "user_id", "session_id", "session_hit_number")


@query(f"SELECT 'app' || user_id % 3 AS application, {_NAME} AS feature_nice_name, event_type, count(DISTINCT user_id) AS user_id_nunique FROM events WHERE event_type <> 'view' GROUP BY 1, 2, 3")
def top_product_features(t):
    return EventModels().agg.top_product_features(events.extract_contexts(_raw(t)))


_RAW_SESSIONS = _SESSIONS.replace("ts, event_id", "ts, event_id::VARCHAR").replace("b.ts, b.event_id)", "b.ts, b.event_id::VARCHAR)")


@query(_RAW_SESSIONS + f""", m AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY session_id) AS al, sum((event_type = 'purchase')::INT) OVER (PARTITION BY session_id ORDER BY moment) AS nw FROM s)
SELECT 'app' || user_id % 3 AS application, {_NAME} AS feature_nice_name, event_type, count(DISTINCT user_id) AS unique_users FROM m WHERE event_type <> 'view' AND al >= 1 AND nw = 0 GROUP BY 1, 2, 3""")
def top_features_before_conversion(t):
    own = EventModels()
    name = own.add_conversion_event(event_type="purchase")
    return own.agg.top_product_features_before_conversion(events.session_frame(_raw(t)), name)


@query(_RAW_SESSIONS + """SELECT event_id::VARCHAR AS event_id, event_id % 3 = 0 AND event_type = 'click' AS is_conversion_event, CAST(sum((event_id % 3 = 0 AND event_type = 'click')::INT) OVER (PARTITION BY session_id ORDER BY moment) AS BIGINT) AS conversions_in_time, CAST(sum((event_id % 3 = 0 AND event_type = 'click')::INT) OVER (PARTITION BY session_id) AS BIGINT) AS conversions_counter FROM s""")
def named_conversions(t):
    own = EventModels()
    name = own.add_conversion_event(events.navigation_features(F.col("location_stack")), "click", "nav_click")
    df = own.map.conversions_counter(own.map.conversions_in_time(own.map.is_conversion_event(events.session_frame(_raw(t)), name), name), name)
    return df.select("event_id", "is_conversion_event", "conversions_in_time", "conversions_counter")


@query(_SESSIONS + "SELECT event_type, count(DISTINCT session_id) AS unique_sessions FROM s GROUP BY 1")
def unique_sessions(t):
    return EventModels().agg.unique_sessions(_sessions(t), ["event_type"])


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS time_aggregation, count(DISTINCT user_id) AS unique_users FROM events GROUP BY 1")
def users_by_default_time(t):
    return EventModels().agg.unique_users(t("events").withColumnRenamed("ts", "moment"))


@query("WITH p AS (SELECT DISTINCT user_id, date_trunc('month', ts) AS p FROM events WHERE event_type = 'click'), f AS (SELECT *, min(p) OVER (PARTITION BY user_id) AS f FROM p), g AS (SELECT *, date_diff('month', f, p) AS d FROM f) SELECT strftime(f, '%Y-%m-%d') AS first_cohort, CASE WHEN count(*) FILTER (d = 0) > 0 THEN 100.0 END::DOUBLE AS _0, round(nullif(count(*) FILTER (d = 1), 0) * 100.0 / count(*) FILTER (d = 0), 6) AS _1 FROM g GROUP BY 1")
def retention_of_clicks(t):
    out = models.retention_matrix(t("events").withColumnRenamed("ts", "moment"), "monthly", 2, percentage=True, event_type="click")
    return out.select("first_cohort", "_0", F.round("_1", 6).alias("_1"))


# Ingestion

SCHEMA = EventSchema(
    Hierarchy({"AbstractEvent": {}, "InteractiveEvent": {"parents": ["AbstractEvent"], "requires": ["LinkContext"]}, "click": {"parents": ["InteractiveEvent"]}, "purchase": {"parents": ["InteractiveEvent"], "requires": ["CartContext"]}, "view": {"parents": ["AbstractEvent"]}}),
    Hierarchy({"AbstractContext": {}, "LinkContext": {"parents": ["AbstractContext"]}, "CartContext": {"parents": ["AbstractContext"]}, "PathContext": {"parents": ["AbstractContext"]}}),
)
_NOW = 10_000_000


def _requests(t):
    """A request for each event: sent 500 ms after the client's clock says, which is event_id ms behind."""
    e = t("events")
    event = F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("_type"), (F.lit(_NOW) - F.col("event_id") - (F.col("user_id") % 50) * 100_000).alias("time"), F.array(F.struct(F.lit("LinkContext").alias("_type"), F.lit("go").alias("id"))).alias("global_contexts"))
    return e.select(F.to_json(F.struct(F.array(event).alias("events"), (F.lit(_NOW) - F.col("event_id")).alias("transport_time"))).alias("body"), F.lit(_NOW).cast("long").alias("received_ms"))


@query(f"""SELECT event_id::VARCHAR AS id, {_NOW} - (user_id % 50) * 100000 AS time, CASE WHEN event_type = 'purchase' THEN 'missing_context' WHEN event_type NOT IN ('click', 'view') THEN 'unknown_type' WHEN (user_id % 50) * 100000 > 3600000 THEN 'too_old' END AS reason FROM events""")
def ingestion_verdicts(t):
    found = ingest.request_events(_requests(t))
    return found.select("id", "time", ingest.reject_reason(F.lit(_NOW), SCHEMA.required()).alias("reason"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'AbstractEvent,InteractiveEvent,click' WHEN 'purchase' THEN 'AbstractEvent,InteractiveEvent,purchase' WHEN 'view' THEN 'AbstractEvent,view' END AS types, '["AbstractContext","LinkContext"]' AS link, true AS known FROM events""")
def hydrated_types(t):
    contexts = F.lit('[{"_type": "LinkContext", "id": "go"}]')
    hydrated = F.from_json(SCHEMA.hydrated(contexts), "array<map<string,string>>")
    return t("events").select("event_id", F.array_join(SCHEMA.event_types(F.col("event_type")), ",").alias("types"), F.get(hydrated, F.lit(0))["_types"].alias("link"), SCHEMA.known_contexts(contexts).alias("known"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 's' || user_id END AS source, CASE WHEN event_id % 2 = 0 THEN 'a b' END AS campaign, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 2 END::BIGINT AS n, 'agent' AS agent FROM events")
def enriched_contexts(t):
    url = F.concat(F.lit("https://x.example/p?utm_source=s"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.lit("&utm_medium=m&utm_campaign=a+b")).otherwise(F.lit("&utm_medium=m")))
    df = t("events").select("event_id", F.to_json(F.array(F.create_map(F.lit("_type"), F.lit("PathContext"), F.lit("id"), url))).alias("global_contexts"))
    out = ingest.add_http_context(ingest.add_marketing_context(df), F.lit(None).cast("string"), F.lit("agent"))
    g = F.col("global_contexts")
    return out.select("event_id", events.context_value(g, "MarketingContext", "source").alias("source"), events.context_value(g, "MarketingContext", "campaign").alias("campaign"), F.json_array_length(g).cast("long").alias("n"), events.user_agent(g).alias("agent"))
