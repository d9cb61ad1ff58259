import datetime, random
import numpy as np, pandas as pd, pytest
from pyspark.sql import functions as F
from rivulet.frame import Frame
from rivulet.operators import grouping


def test_ranks_against_pandas(spark):
    """Groups of one value, of many equal ones, of none, and one with most rows; negative zero and infinity."""
    r = random.Random(3)
    rows = [("hot", r.choice([r.gauss(0, 1), 0.0, -0.0, 5.0, float("inf")]), f"{'same prefix ' * r.randrange(2)}{r.randrange(99)}") for _ in range(3000)]
    rows += [("one", 2.5, "é"), ("none", None, None), (None, 1.0, "a"), (None, 4.0, "b")]
    df = spark.createDataFrame(rows, "k string, x double, s string")
    qs = [0.0, 0.1, 0.5, 0.99, 1.0]
    pdf = pd.DataFrame(rows, columns=["k", "x", "s"])
    got = {r[0]: r[1] for r in grouping.quantiles_by(df, ["k"], ["x"], qs).collect()}
    assert set(got) == {"hot", "one", "none", None} and got["none"] is None
    for k, part in pdf.groupby("k", dropna=False):
        x = np.sort(part["x"].dropna().to_numpy())
        if len(x):
            at = [q * (len(x) - 1) for q in qs]
            lo, hi = [x[int(np.floor(a))] for a in at], [x[int(np.ceil(a))] for a in at]
            assert got[None if pd.isna(k) else k] == pytest.approx([a if a == b else a + (b - a) * (p - np.floor(p)) for a, b, p in zip(lo, hi, at)])
    medians = {r["k"]: r["s_median"] for r in Frame(df).groupby("k").agg({"s": "median"}).df.collect()}
    for k, part in pdf.groupby("k", dropna=False):
        s = sorted(part["s"].dropna(), key=lambda v: v.encode())
        assert medians[None if pd.isna(k) else k] == (s[(len(s) + 1) // 2 - 1] if s else None)


def test_ranks_of_types(spark):
    days = [datetime.date(1950, 1, 1) + datetime.timedelta(days=i * 37) for i in range(999)]
    rows = [(d, datetime.datetime(2024, 3, 10, i % 24, i % 60, 7, i), i % 2 == 0) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "d date, t timestamp_ntz, b boolean").withColumn("n", F.expr("cast(day(d) as decimal(9,2))")).withColumn("z", F.col("t").cast("timestamp"))
    one = Frame(df).agg({c: "median" for c in df.columns}).df.first()
    for c in df.columns:
        assert one[f"{c}_median"] == sorted(r[c] for r in df.collect())[499], c


def test_ranks_of_nothing(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert Frame(df).quantile(["x"], [0.5, 0.9]).df.collect() == [(0.5, None), (0.9, None)]
    assert Frame(df).groupby("k").quantile(["x"]).df.collect() == []
    assert Frame(df).agg({"x": "median"}).df.first()[0] is None
    with pytest.raises(ValueError):
        Frame(df).quantile(["x"], 1.5)
