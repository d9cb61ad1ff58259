"""The event fixture: contexts, identities, sessions and models with known results."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rivulet.frame import Frame
from rivulet.functions import scalars, temporal
from rivulet.operators import shaping, windows
from rivulet.plans import events, models
from rivulet.plans.event_models import EventModels
from rivulet.streaming import ingest

TIMES = [
    (301, "b2", "2021-11-30 10:23:36.287"), (302, "b2", "2021-11-30 10:23:36.290"), (303, "b2", "2021-11-30 10:23:36.291"), (304, "b1", "2021-11-30 10:23:36.267"),
    (305, "b1", "2021-12-01 10:23:36.276"), (306, "b1", "2021-12-01 10:23:36.279"), (307, "b3", "2021-12-02 10:23:36.281"), (308, "b3", "2021-12-02 10:23:36.281"),
    (309, "b3", "2021-12-02 14:23:36.282"), (310, "b4", "2021-12-03 10:23:36.283"), (311, "b2", "2021-11-29 10:23:36.286"), (312, "b2", "2021-11-29 10:23:36.287"),
]


@pytest.fixture(scope="module")
def raw(spark):
    rows = []
    for event, user, at in TIMES:
        moment = datetime.fromisoformat(at)
        stack = [{"_type": "WebDocumentContext", "id": "#document"}, {"_type": "NavigationContext", "id": "nav"}, {"_type": "LinkContext", "id": "go"}]
        contexts = [{"_type": "ApplicationContext", "id": "site"}] + ([{"_type": "IdentityContext", "id": "email", "value": f"{user}@x"}] if user in ("b1", "b4") else [])
        value = {"_type": "ClickEvent", "_types": ["ClickEvent", "InteractiveEvent"], "global_contexts": contexts, "location_stack": stack}
        rows.append((str(event), date(moment.year, moment.month, moment.day), moment, user, json.dumps(value)))
    return spark.createDataFrame(rows, "event_id string, day date, moment timestamp_ntz, cookie_id string, value string")


@pytest.fixture(scope="module")
def sessions(raw):
    return events.session_frame(raw)


def test_sessions(sessions):
    got = {r.event_id: (r.session_id, r.session_hit_number) for r in sessions.collect()}
    assert len({s for s, _ in got.values()}) == 7
    assert [got[e] for e in ("304", "305", "306")] == [(2, 1), (4, 1), (4, 2)]
    first = {r.event_id for r in sessions.withColumn("f", models.is_first_session()).where("f").collect()}
    assert first == {"304", "307", "308", "310", "311", "312"}


def test_counts(sessions):
    assert models.unique_users(sessions, []).first()[0] == 4
    by_month = sessions.withColumn("m", models.time_agg(F.col("moment"), "%Y-%m"))
    assert {tuple(r) for r in models.unique_users(by_month, ["m"]).collect()} == {("2021-11", 2), ("2021-12", 3)}
    assert {tuple(r) for r in models.frequency(sessions).collect()} == {(1, 1), (2, 3)}
    assert models.session_duration(sessions, []).first()[0] == pytest.approx(0.0026667, abs=1e-6)
    assert models.session_duration(sessions, [], exclude_bounces=False).first()[0] == pytest.approx(0.001143, abs=1e-6)


@pytest.mark.parametrize(("period", "want"), [("yearly", {("2021-01-01", 4, None)}), ("monthly", {("2021-11-01", 2, 1), ("2021-12-01", 2, None)}), ("weekly", {("2021-11-29", 4, None)}), ("daily", {("2021-11-29", 1, 1), ("2021-11-30", 1, 1), ("2021-12-02", 1, None), ("2021-12-03", 1, None)})])
def test_retention(sessions, period, want):
    assert {tuple(r) for r in models.retention_matrix(sessions, period, 2).collect()} == want


def test_contexts_and_identities(raw):
    df = events.extract_contexts(raw)
    one = df.select(events.context_value(F.col("global_contexts"), "ApplicationContext", "id").alias("app"), events.nice_name(F.col("location_stack")).alias("name")).first()
    assert tuple(one) == ("site", "Link: go located at Web Document: #document => Navigation: nav")
    users = {r.user_id for r in events.resolve_identities(df).select("user_id").distinct().collect()}
    assert users == {"b1@x|email", "b2", "b3", "b4@x|email"}
    hidden = events.session_frame(raw, resolve=True, anonymous=True)
    assert {r.user_id for r in hidden.select("user_id").distinct().collect()} == {"b1@x|email", "b4@x|email", None}


def test_features_parse_once(raw, spark):
    """The plan parses a value once, its contexts once and its stack once; groups with an unknown key are left out."""
    made = raw.withColumn("value", F.concat("value", F.lit("")))
    out = EventModels().agg.top_product_features(events.extract_contexts(made))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("json_tuple(") == 1 and "get_json_object(" not in plan
    assert plan.count("from_json(ArrayType(MapType") == 2  # contexts and stack
    assert [tuple(r) for r in out.collect()] == [("site", "Link: go located at Web Document: #document => Navigation: nav", "ClickEvent", 4)]
    text = lambda **more: json.dumps({"_type": "ClickEvent", "_types": ["InteractiveEvent"], "global_contexts": [{"_type": "ApplicationContext", "id": "a"}], "location_stack": [{"_type": "MediaPlayerContext", "id": "v"}], **more})
    odd = [None, "{", "[]", "{}", text(), text(), text(global_contexts=[]), text(location_stack=[]), text(location_stack=None), text(_type=None), text(_types=["x"]), text(location_stack=[{"_type": "A"}])]
    rows = [(str(i), f"u{i}", v) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "event_id string, cookie_id string, value string").withColumns({"day": F.lit("2024-01-01").cast("date"), "moment": F.lit("2024-01-01").cast("timestamp_ntz")})
    assert [tuple(r) for r in EventModels().agg.top_product_features(events.extract_contexts(df)).collect()] == [("a", "Media Player: v", "ClickEvent", 2)]


def test_stream(spark, tmp_path):
    now, ok = 10_000_000, '[{"_type": "ApplicationContext", "id": "a"}]'
    rows = [("1", "ClickEvent", now - 5, ok, "[]"), ("1", "ClickEvent", now - 5, ok, "[]"), ("2", "ClickEvent", now - 4_000_000, ok, "[]"), ("3", "ClickEvent", now + 1, ok, "[]"), ("4", "Nothing", now, ok, "[]"), ("5", "ClickEvent", now, "[]", "[]"), (None, "ClickEvent", now, ok, "[]")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, ingest.SCHEMA).coalesce(1).write.json(source)
    for _ in range(2):
        q = ingest.start(spark.readStream.schema(ingest.SCHEMA).json(source), str(tmp_path / "ok"), str(tmp_path / "nok"), str(tmp_path / "ck"), {"ClickEvent": ["ApplicationContext"]}, F.lit(now))
        assert q.awaitTermination(120)
        spark.createDataFrame(rows[:1], ingest.SCHEMA).coalesce(1).write.mode("append").json(source)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == ["1"]
    reasons = sorted(r.reason for r in spark.read.parquet(str(tmp_path / "nok")).collect())
    assert reasons == ["duplicate", "in_future", "missing_context", "no_id", "too_old", "unknown_type"]


def test_split_of_a_batch(spark):
    """The earliest of an id stays, whatever the batch's order; known ids are rejected, an empty history rejects none."""
    rows = [("1", "A", t, "[]", "[]") for t in (30, 10, 20)] + [("2", "A", 5, "[]", "[]"), ("2", "A", 5, "[]", "[]"), ("3", "A", 7, "[]", "[]")]
    batch = spark.createDataFrame(rows, ingest.SCHEMA).repartition(4)
    known = spark.createDataFrame([("2", "A", 1, "[]", "[]"), ("9", "A", 1, "[]", "[]")] * 50, ingest.SCHEMA)
    good, bad = ingest.split_batch(batch, F.lit(100), {"A": []}, known)
    assert sorted((r.id, r.time) for r in good.collect()) == [("1", 10), ("3", 7)]
    assert [(r.id, r.reason) for r in bad.collect()] == [("2", "duplicate")]
    good, bad = ingest.split_batch(batch, F.lit(100), {"A": []}, known.limit(0))
    assert sorted(r.id for r in good.collect()) == ["1", "2", "3"] and bad.isEmpty()


def test_files(spark, tmp_path):
    events_ = spark.createDataFrame([("1", "A", 86_400_000, "[]", "[]"), ("2", "A", None, "[]", "[]")], ingest.SCHEMA)
    for verdict in ("OK", "NOK", "OK"):
        ingest.write_files(events_, str(tmp_path / "out"), verdict, F.col("time"))
    back = spark.read.json(str(tmp_path / "out"))
    assert sorted((r.id, r.verdict, str(r.day)) for r in back.collect()) == sorted([("1", v, "1970-01-02") for v in ("OK", "NOK", "OK")] + [("2", v, "None") for v in ("OK", "NOK", "OK")])
    with pytest.raises(ValueError):
        ingest.write_files(events_, str(tmp_path), "MAYBE")


def test_json(spark):
    text = '[{"a": "b", "c": 1}, {"a": "x"}, {"a": "y", "n": [1, 2]}]'
    df = spark.createDataFrame([(text,), (None,)], "j string")
    j = F.col("j")
    one = df.select(scalars.json_value(j, -1).alias("last"), scalars.json_find(j, {"a": "x"}).alias("at"), scalars.json_slice(j, {"a": "x"}).alias("some"), scalars.json_slice(j, 1, -1).alias("mid"), scalars.json_slice(j, 5).alias("none"), scalars.json_length(j).alias("n")).collect()
    assert tuple(one[0]) == ('{"a":"y","n":[1,2]}', 1, '[{"a":"x"},{"a":"y","n":[1,2]}]', '[{"a":"x"}]', "[]", 3)
    assert one[1].some is None and one[1].n is None
    assert df.select(scalars.json_canonical(F.lit('{"b": 1, "a": [ ]}')).alias("c")).first().c == '{"a":[],"b":1}'


def test_frame(spark):
    import pandas as pd

    pdf = pd.DataFrame({"k": ["a", "a", "b", None], "x": [1.0, 2.5, None, 4.0]})
    f = Frame.from_pandas(spark, pdf)
    assert f.index == ("_index_0",) and f.to_pandas().shape == (4, 2)
    assert f.fillna({"x": 0.0}).df.agg(F.sum("x")).first()[0] == 7.5
    assert f.dropna().df.count() == 2
    assert f.where_set(f["k"] == "a", "x", 9.0).df.where("x = 9.0").count() == 2
    assert [r.x for r in f.sort_values("x", False)[0:2].df.collect()] == [4.0, 2.5]
    with pytest.raises(KeyError):
        f.drop(["nothing"])
    with pytest.raises(ValueError):
        f.rename({"k": "x"})
    s = f.sample(50, 3).assign(y=lambda g: g["x"] * 2)
    assert s.unsampled().df.count() == 4 and "y" in s.unsampled().df.columns
    got = f.append(Frame(spark.createDataFrame([(1,)], "x int"))).df
    assert got.count() == 5 and dict(got.dtypes)["x"] == "double"


def test_windows_and_quantiles(spark):
    df = spark.createDataFrame([(k, i, float(i * i)) for k in "ab" for i in range(5)], "k string, i int, x double")
    f = Frame(df).groupby("k").sort_values("i")
    got = f.rolling({"x": "sum"}, 2).expanding({"x": "max"}).over(n=F.row_number(), before=F.lag("x")).df.where("k = 'a'").orderBy("i").collect()
    assert [r.x_sum for r in got] == [None, 1.0, 5.0, 13.0, 25.0]
    assert [(r.x_max, r.n, r.before) for r in got][-1] == (16.0, 5, 9.0)
    out = Frame(df).groupby("k").quantile(["x"], [0.25, 0.5])
    assert out.index == ("k", "quantile") and {(r.quantile, r.x) for r in out.df.collect()} == {(0.25, 1.0), (0.5, 4.0)}
    hist = Frame(df).hist(["i", "x"], 4).df.collect()
    assert [(r.lower, r.i, r.x) for r in hist] == [(0.0, 10, 6), (4.0, 0, 0), (8.0, 0, 2), (12.0, 0, 2)]


def test_frames_without_end(spark):
    """Frames that have no end are carried on from the window's end, not computed anew for each row."""
    rows = [(k, i, None if i % 4 == 1 else i // 2, None if i % 3 else float(i)) for k in "ab" for i in range(40)]
    df = spark.createDataFrame(rows, "k string, i int, g int, x double")
    for up in (True, False):
        by_i, by_g = windows.window(["k"], ["i"], up), windows.window(["k"], ["g"], up)
        made = {
            "n": (windows.framed(F.count("*"), by_i, -1, None), by_i.rowsBetween(-1, Window.unboundedFollowing), F.count("*")),
            "s": (windows.framed(F.sum("x"), by_i, 2, None), by_i.rowsBetween(2, Window.unboundedFollowing), F.sum("x")),
            "m": (windows.framed(F.min("x"), by_g, -2, None, "range"), by_g.rangeBetween(-2, Window.unboundedFollowing), F.min("x")),
            "c": (windows.framed(F.count("x"), by_g, 0, None, "range"), by_g.rangeBetween(0, Window.unboundedFollowing), F.count("x")),
            "b": (windows.bfill(F.col("x"), by_i), by_i.rowsBetween(0, Window.unboundedFollowing), F.first("x", ignorenulls=True)),
        }
        out = df.select("k", "i", *[v[0].alias(c) for c, v in made.items()])
        assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
        want = df.select("k", "i", *[v[2].over(v[1]).alias(c) for c, v in made.items()])
        assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
        first = df.select("i", windows.framed(F.first("i"), by_i, 1, None).alias("f")).where("k = 'a'").collect()
        assert {r.i: r.f for r in first} == {i: j if 0 <= j < 40 else None for i in range(40) for j in [i + 1 if up else i - 1]}


@pytest.mark.parametrize("right", [True, False])
def test_cut_like_pandas(spark, right):
    import pandas as pd

    want = pd.cut(pd.Series(range(100)), bins=10, right=right)
    got = {r.x: r.range for r in shaping.cut(spark.range(100).withColumnRenamed("id", "x"), "x", 10, right).collect()}
    for x, i in zip(range(100), want, strict=True):
        assert (got[x].lower, got[x].upper) == (pytest.approx(i.left), pytest.approx(i.right))


def test_strftime_quotes(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 3, 4, 5, 6),)], "t timestamp_ntz")
    assert df.select(temporal.strftime(F.col("t"), "it's %H o'clock, Q%Q %C %w").alias("s")).first().s == "it's 04 o'clock, Q1 21 4"
    with pytest.warns(UserWarning):
        temporal.strftime(F.col("t"), "%U")
