"""What SQL on the test tables can't show: errors, savepoints, types, schemas, queues, and the hard cases of frames."""

import pytest
from pyspark.sql import functions as F

from rivulet.frame import Frame
from rivulet.functions import scalars
from rivulet.operators import joining, shaping
from rivulet.plans import events
from rivulet.plans.event_models import EventModels
from rivulet.savepoints import Savepoints
from rivulet.series import Series
from rivulet.streaming import ingest
from rivulet.streaming.schema import EventSchema, Hierarchy
from rivulet.types import REGISTRY, TypeRegistry, parse_type, same_type


@pytest.fixture
def f(spark):
    return Frame(spark.createDataFrame([(1, "a", 2.0), (2, "b", None), (3, "a", 5.0)], "i long, k string, x double"), ("i",))


def test_series_sinks(f):
    assert f.x.sum().value == 7.0 and f.x.max().value == 5.0
    assert f.x.to_pandas().to_dict()[3] == 5.0 and len(f.k.to_numpy()) == 3 and f.k.head(2).shape == (2,)
    assert f.k[2].value == "b" and [r.x for r in f.x[0:1].frame.df.collect()] == [2.0]
    assert sorted(f.k.array) == ["a", "a", "b"] and f.x.equals(f.x) and not f.x.equals(f.k)
    with pytest.raises(ValueError, match="one value"):
        _ = f.x.value
    with pytest.raises(ValueError, match="skipped"):
        f.x.sum(skipna=False)
    with pytest.raises(TypeError):
        f.k.sum()
    with pytest.raises(TypeError):
        _ = f.x << 1
    with pytest.raises(ValueError, match="sorted"):
        f.x.window_rank()
    with pytest.raises(ValueError, match="numbers only"):
        f.sum()
    with pytest.raises(AttributeError):
        _ = f.nothing


def test_series_of_other_frames(spark, f):
    one = Frame(spark.createDataFrame([(10.0,)], "y double")).y.max()
    assert [r.z for r in f.assign(z=f.x + one).sort_values("i").to_spark().collect()] == [12.0, None, 15.0]
    other = Frame(spark.createDataFrame([(1, 7), (3, 9)], "i long, n long"), ("i",))
    assert [r.z for r in f.assign(z=other.n).sort_values("i").to_spark().collect()] == [7, None, 9]
    assert {r.i for r in f[f.k.isin(Frame(spark.createDataFrame([("b",)], "k string")).k)].df.collect()} == {2}
    with pytest.raises(ValueError, match="index"):
        f.assign(z=Frame(spark.range(2)).id)


def test_random_and_views(spark, f):
    u = f.assign(u=Series.random_uuid(f), r=Series.random(f, 3)).to_pandas()
    assert u["u"].nunique() == 3 and u["r"].between(0, 1).all()
    assert [r.i for r in spark.sql(f.sort_values("x", False).view_sql("some_view")).collect()] == [3, 1, 2]


def test_whole_numbers_stay_exact(spark):
    big = 9007199254740993
    row = spark.range(1).select(scalars.int_floordiv(F.lit(big), F.lit(1)), scalars.int_mod(F.lit(-big), F.lit(2)), scalars.int_floordiv(F.lit(-7), F.lit(2)), scalars.int_floordiv(F.lit(7), F.lit(0)), scalars.mod(F.lit(7.5), F.lit(0)), scalars.int_mod(F.lit(7), F.lit(-2))).first()
    assert tuple(row) == (big, 1, -4, None, None, -1)


def test_unsampled_does_all_steps_again(spark, f):
    s = f.sample(50, 1).set_index(["i"]).append(Frame(spark.createDataFrame([(9, "c", 1.0)], "i long, k string, x double"))).groupby("k").agg({"x": "sum"}).sort_values("k")[0:2]
    assert [tuple(r) for r in s.unsampled().to_spark().collect()] == [("a", 7.0), ("b", None)]
    with pytest.raises(ValueError, match="sample"):
        f.unsampled()
    table = f.sample(50, 1).to_table("sample_of_f", "replace")
    with pytest.raises(ValueError, match="isn't done again"):
        Frame(table.df, source=f, steps=table.steps).unsampled()


def test_variables(f):
    g, v = f.create_variable("least", 1)
    out = g[g["i"] > v].assign(y=lambda h: h["x"] * h.variable("least"))
    assert out.data == ["k", "x", "y"] and out.to_spark().count() == 2
    again = out.set_variable("least", 2)
    assert [tuple(r) for r in again.to_spark().collect()] == [(3, "a", 5.0, 10.0)] and out.to_spark().count() == 2
    assert out.variable_usage()["least"] == 1
    with pytest.raises(ValueError, match="int"):
        out.set_variable("least", "x")
    with pytest.raises(KeyError):
        f.variable("none")


def test_savepoints(spark, f):
    g = f.set_savepoint("first").assign(y=1).set_savepoint("second", "view").groupby("k").agg({"y": "sum"}).set_savepoint("third", "table")
    points = Savepoints(g)
    assert list(points.points) == ["first", "second", "third"] and points.get_df("first").data == ["k", "x"]
    spark.sql("DROP TABLE IF EXISTS third")
    made = points.write(spark)
    assert made["second"].df.count() == 3 and {tuple(r) for r in made["third"].df.collect()} == {("a", 2), ("b", 1)}
    for name, text in points.create_statements().items():
        if name == "third":
            spark.sql(points.drop_statements()[name])
            spark.sql(text)
    assert spark.table("third").count() == 2
    spark.sql("DROP TABLE third")
    points.set_materialization("third", "query")
    points.remove_savepoint("first")
    assert list(points.drop_statements()) == ["second"]
    with pytest.raises(ValueError, match="already"):
        g.set_savepoint("third")
    with pytest.raises(ValueError, match="name"):
        g.set_savepoint("no name")


def test_dotted_names_and_constants(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0)], "`a.b` long, x double")
    assert joining.merge(df, df, on=["a.b"]).columns == ["a.b", "x_x", "x_y"]
    assert [r.x for r in shaping.scale(df, ["x"]).collect()] == [0.0, 0.0] and [r.x for r in shaping.minmax_scale(df, ["x"]).collect()] == [0.0, 0.0]
    with pytest.raises(ValueError, match="null label"):
        shaping.unstack(spark.createDataFrame([(1, None)], "i long, l string"), ["i"], "l", ["i"])


def test_medians_and_modes(spark):
    rows = [("a", "x"), ("a", "y"), ("a", "y"), ("a", None), ("b", None), (None, "z"), (None, "w")]
    g = Frame(spark.createDataFrame(rows, "k string, v string")).groupby("k")
    assert {tuple(r) for r in g.agg({"v": ["median", "mode", "count"]}).df.collect()} == {("a", "y", "y", 3), ("b", None, None, 0), (None, "w", "w", 2)}


def test_events_without_a_moment(spark):
    rows = [(1, "u", "2024-01-01 00:00:00"), (2, "u", None), (3, "v", None), (4, "v", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "event_id long, user_id string, moment string").withColumn("moment", F.col("moment").cast("timestamp_ntz"))
    got = {r.event_id: (r.session_id, r.session_hit_number) for r in events.sessionize(df).collect()}
    assert got == {2: (1, 1), 3: (2, 1), 1: (3, 1), 4: (4, 1)}


def test_model_rules(spark):
    m = EventModels()
    with pytest.raises(ValueError):
        m.add_conversion_event()
    with pytest.raises(KeyError):
        m.conversion("none")
    with pytest.raises(ValueError, match="missing"):
        m.agg.frequency(spark.range(1))
    df = spark.createDataFrame([("u", "2024-01-01 00:00:00")], "user_id string, moment string")
    with pytest.raises(ValueError, match="by"):
        m.agg.unique_users(df, ["user_id"])
    with pytest.raises(ValueError, match="type"):
        events.check_frame(df, ["moment"])
    assert m.add_conversion_event(event_type="x") == "conversion_1"


def test_schema():
    h = Hierarchy({"A": {}, "B": {"parents": ["A"], "requires": ["c"]}, "C": {"parents": ["B"]}})
    assert h.above("C") == {"A", "B", "C"} and h.under("B") == {"B", "C"} and h.required("C") == {"c"}
    schema = EventSchema(h, Hierarchy({"c": {}})).extended({"D": {"parents": ["C"]}, "A": {"requires": ["d"]}}, {"d": {}})
    assert schema.required() == {"A": ["d"], "B": ["c", "d"], "C": ["c", "d"], "D": ["c", "d"]}
    for bad in ({"A": {"parents": ["X"]}}, {"A": {"parents": ["B"]}, "B": {"parents": ["A"]}}):
        with pytest.raises(ValueError):
            Hierarchy(bad)
    with pytest.raises(ValueError, match="need"):
        EventSchema(h)


def test_requests_and_queue(spark, tmp_path):
    bodies = ['{"events": [{"id": "1", "_type": "click", "time": 90}, {"id": "2"}], "transport_time": 100}', "oops", '{"events": 3}', None, '{"events": [' + ",".join(["{}"] * 1001) + "]}"]
    df = spark.createDataFrame([(b, 150) for b in bodies], "body string, received_ms long")
    got = {r.id: r for r in ingest.request_events(df).collect()}
    assert set(got) == {"1", "2"} and got["1"].time == 140 and got["2"].time is None and got["1"].global_contexts == "[]"
    assert ingest.bad_requests(df).count() == 4
    ingest.enqueue(ingest.request_events(df), str(tmp_path / "q"))
    q = ingest.queued(spark, str(tmp_path / "q")).writeStream.format("memory").queryName("queued_events").trigger(availableNow=True).start()
    assert q.awaitTermination(60) and spark.table("queued_events").count() == 2


def test_types(f):
    assert same_type(parse_type("ARRAY<STRUCT<a INT64, b STRING>>"), parse_type("array<struct<a: bigint, b: string>>"))
    assert REGISTRY.of_value(True) == "bool" and REGISTRY.of_value(3) == "int64" and REGISTRY.spark_type("timedelta").simpleString() == "interval day to second"
    own = TypeRegistry()

    @own.register("money", "double", override=True)
    class Money(Series):
        def euros(self):
            return self._new(F.format_number(self.column, 2))

    del own.names["float64"]
    assert [r.x for r in f.assign(x=own.series(f, "x").euros()).sort_values("i").to_spark().collect()] == ["2.00", None, "5.00"]
    with pytest.raises(ValueError):
        own.register("money", "double")(Money)
    with pytest.raises(ValueError):
        own.of_value(object())
