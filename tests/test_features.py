from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronoweir.functions.durations import duration_micros
from chronoweir.operators import features
from chronoweir.operators.spec import Bins, SeriesSpec, micros
from chronoweir.sources.frames import ListWindow, from_list, to_list

SPEC = SeriesSpec("seq")


def test_list_lags_and_rolling(spark):
    w = ListWindow(spark, [1, 2], [3])
    one, two = w.transform([1.0, 2.0, 3.0, 4.0, 5.0])
    assert one == [None, 1.0, 2.0, 3.0, 4.0] and two == [None, None, 1.0, 2.0, 3.0]
    assert w.rolling_mean([1.0, 2.0, 3.0, 4.0, 5.0], 3) == [None, None, 2.0, 3.0, 4.0]
    assert w.rolling_mean([1.0, 2.0], 5) == [None, None]


def test_lag_edges(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(3)], "seq long, value long")
    assert to_list(df.withColumn("l", features.lag(SPEC, "value", 0)), "l") == [1, 2, 3]
    lagged = features.generate_lag(df, SPEC, "value", 3)
    assert lagged.schema["value"].dataType.simpleString() == "bigint"
    assert to_list(lagged, "value") == [None] * 3
    with pytest.raises(ValueError, match="cannot exceed"):
        features.generate_lag(df, SPEC, "value", 4)
    with pytest.raises(ValueError, match="non-negative"):
        features.generate_lag(df, SPEC, "value", -1)
    with pytest.raises(ValueError, match="window must be positive"):
        features.rolling_mean(SPEC, "value", 0)


@pytest.mark.parametrize("run_rows", [0, 1, 3, 100])
def test_transform_over_one_series_is_the_same_in_runs(spark, run_rows):
    df = spark.createDataFrame([(t, v) for t, v in zip(range(1, 5), (10.0, 11.0, 13.0, 16.0), strict=True)], "t long, value double")
    made = features.FeatureWindow(SeriesSpec("t"), [1], [2]).transform(df, "value", run_rows=run_rows)
    rows = made.orderBy("t").collect()
    assert made.columns == ["t", "value", "value_lag_1", "value_rolling_2"]
    assert [r["value_lag_1"] for r in rows] == [None, 10.0, 11.0, 13.0]
    assert [r["value_rolling_2"] for r in rows] == [None, 10.5, 12.0, 14.5]


def test_include_original_and_clashes(spark):
    df = from_list(spark, [1.0, 2.0])
    w = features.FeatureWindow(SPEC, [1], [2])
    assert w.transform(df, "value", include_original=False).columns == ["value_lag_1", "value_rolling_2"]
    with pytest.raises(ValueError, match="already present"):
        w.transform(df.withColumn("value_lag_1", F.lit(1)), "value", run_rows=0)


@pytest.mark.parametrize("ignore", [False, True])
def test_ema_equals_pandas(spark, ignore):
    import numpy as np
    import pandas as pd

    values = [1.0, None, 4.0, 2.5, None, None, 8.0, 1.0]
    want = pd.Series(values).ewm(alpha=0.3, adjust=False, ignore_na=ignore).mean().where(pd.Series(values).notna())
    df = from_list(spark, values)
    for got in (to_list(df.withColumn("m", features.ema(SPEC, "value", 0.3, ignore)), "m"), to_list(features.ema_pass(df, SPEC, "value", 0.3, ignore), "value_ema_0.3")):
        assert np.allclose([np.nan if x is None else x for x in got], want.to_numpy(), equal_nan=True)
    assert to_list(df.withColumn("m", features.ema(SPEC, "value", 1.0)), "m") == values
    for bad in (0, 1.5):
        with pytest.raises(ValueError, match="alpha must be in the interval"):
            features.ema(SPEC, "value", bad)


def test_nulls_expanding_and_weighted(spark):
    df = from_list(spark, [1.0, None, 3.0, 5.0])
    assert to_list(df.withColumn("m", features.rolling_mean(SPEC, "value", 2)), "m") == [None, None, None, 4.0]
    assert to_list(df.withColumn("m", features.expanding_mean(SPEC, "value")), "m") == [1.0, 1.0, 2.0, 3.0]
    assert to_list(df.withColumn("m", features.expanding_mean(SPEC, "value", True)), "m") == [0.25, 0.25, 1.0, 2.25]
    assert to_list(from_list(spark, [1.0, 2.0, 3.0]).withColumn("m", features.wma(SPEC, "value", 2)), "m") == [None, 5 / 3, 8 / 3]


def test_durations(spark):
    assert duration_micros("1h30m") == 5_400_000_000 and duration_micros("7d") == 7 * 86_400_000_000
    for bad in ("", "x", "1mo", "3q", "0d", "1d!"):
        with pytest.raises(ValueError):
            duration_micros(bad)
    rows = [(datetime(2024, 1, 1) + timedelta(days=d), float(d)) for d in (0, 1, 2, 5)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, value double")
    made = df.withColumn("m", features.rolling_mean_duration(df, SeriesSpec("ts"), "value", "2d"))
    assert [r["m"] for r in made.orderBy("ts").collect()] == [0.0, 0.5, 1.5, 5.0]


def test_features_never_see_the_future(spark):
    rows = [(i % 3, i, float(i * i % 17)) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, t long, value double")
    changed = df.withColumn("value", F.when(F.col("t") > 30, F.lit(1e6)).otherwise(F.col("value")))
    w = features.FeatureWindow(SeriesSpec("t", ["k"]), [1, 2], [3], [0.3])
    get = lambda d: sorted(map(tuple, d.filter("t <= 30").collect()))
    want = get(w.transform(df, "value"))
    assert get(w.transform(changed, "value")) == want == get(w.transform(df.repartition(5), "value")) == get(w.transform(df, "value", as_of=30))


def test_row_slice(spark):
    df = from_list(spark, [float(i) for i in range(10)])
    assert to_list(features.row_slice(df, SPEC, 3, 4), "value") == [3.0, 4.0, 5.0, 6.0]
    assert to_list(features.row_slice(df, SPEC, 8), "value") == [8.0, 9.0]


def test_search_in_two_steps(spark):
    from bisect import bisect_left

    from pyspark.sql import functions as F

    from chronoweir.operators.spec import below

    for cuts in ([], [5], list(range(0, 900, 7)), list(range(-64, 64))):
        rows = spark.range(-70, 910).select("id", F.coalesce(below(cuts, F.col("id")), F.lit(0)).alias("n")).collect()
        assert all(r["n"] == bisect_left(cuts, r["id"]) for r in rows)


def test_positions_with_many_bins(spark, monkeypatch):
    from chronoweir.operators import spec as module

    monkeypatch.setattr(module, "BINS", 200)
    rows = spark.range(3000).selectExpr("id * 37 % 1009 AS t", "id AS k").repartition(5)
    got = module.SeriesSpec("t", (), ["k"]).indexed(rows, "i").orderBy("t", "k").collect()
    assert [r["i"] for r in got] == list(range(3000))


def test_a_time_of_many_rows_is_cut_by_its_tie_breaker(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN id ELSE 77 END AS t", "id AS k", "CAST(id % 11 AS DOUBLE) AS value").repartition(5)
    spec = SeriesSpec("t", (), ["k"])
    bins = Bins(rows, spec)
    assert bins.n == 5000 and max(bins.sizes) < 300
    assert [r["i"] for r in spec.indexed(rows, "i").orderBy("t", "k").collect()] == list(range(5000))
    made = features.FeatureWindow(spec, [0, 40], [3]).transform(rows, "value", run_rows=100).orderBy("t", "k").collect()
    assert len(made) == 5000
    for i, r in enumerate(made):
        assert r["value_lag_40"] == (made[i - 40]["value"] if i >= 40 else None) and r["value_lag_0"] == r["value"]
        assert r["value_rolling_3"] == (None if i < 2 else sum(x["value"] for x in made[i - 2 : i + 1]) / 3)


def test_one_series_in_runs_equals_one_window(spark):
    rows = spark.range(2000).selectExpr("CAST(id * 7919 % 2003 AS LONG) * 5 AS t", "id AS k", "IF(id % 9 = 0, NULL, CAST(id % 13 AS DOUBLE)) AS value").repartition(4)
    spec = SeriesSpec("t", (), ["k"])
    one = rows.withColumns({"m": features.rolling_mean_duration(rows, spec, "value", 400), "c": features.cumulative_sum(spec, "value"), "e": features.expanding_mean(spec, "value"), "l": features.expanding_mean(spec, "value", total_length=True)})
    want = {r["k"]: r for r in one.collect()}
    got = features.add_duration_mean(rows, spec, "value", 400, run_rows=50).collect()
    assert len(got) == 2000 and all(r["rolling_mean"] == pytest.approx(want[r["k"]]["m"]) for r in got)
    for total, name in ((False, "e"), (True, "l")):
        got = features.add_expanding(rows, spec, "value", total_length=total).collect()
        assert len(got) == 2000 and all(r["value_cumulative"] == pytest.approx(want[r["k"]]["c"]) and r["value_expanding_mean"] == pytest.approx(want[r["k"]][name]) for r in got)


@pytest.mark.parametrize("zone", ["America/New_York", "UTC"])
def test_clock_changes_of_the_session_move_no_row(spark, zone):
    """Hourly rows over both changes of the clock in 2024; a mean never has a later row."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for day in ("2024-03-10", "2024-11-03"):
            times = [f"{day} {h:02d}:{m:02d}:00" for h in range(5) for m in (0, 15, 30, 45)]
            df = spark.createDataFrame([(t, float(i)) for i, t in enumerate(times)], "s string, value double").selectExpr("to_timestamp_ntz(s) AS ts", "value", "'a' AS k")
            got = df.withColumn("m", features.rolling_mean_duration(df, SeriesSpec("ts", ["k"]), "value", "1h")).orderBy("value").collect()
            assert [r["m"] for r in got] == [sum(range(max(0, i - 3), i + 1)) / min(4, i + 1) for i in range(20)]
            steps = df.select(micros(df, "ts").alias("t")).orderBy("t").collect()
            assert {b["t"] - a["t"] for a, b in zip(steps, steps[1:])} == {900_000_000}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_micros_of_times(spark):
    df = spark.sql("SELECT DATE'1969-12-30' AS d, TIMESTAMP_NTZ'1969-12-31 23:59:59.999999' AS n, TIMESTAMP_NTZ'2200-01-02 03:04:05.000006' AS f")
    assert tuple(df.select(*(micros(df, c) for c in "dnf")).first()) == (-2 * 86_400_000_000, -1, (datetime(2200, 1, 2, 3, 4, 5, 6) - datetime(1970, 1, 1)) // timedelta(microseconds=1))


def test_a_value_stands_once_in_its_search(spark):
    """searches of searches must not multiply the work for a row, and none is an interpreted lambda."""
    from pyspark.sql import functions as F

    from chronoweir.operators.spec import below

    df = spark.range(10)
    cuts = list(range(0, 3000, 3))
    plan = df.filter(below(cuts, below(cuts, F.col("id") + 77777)) > 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("77777") == 1 and "lambda" not in plan
    floats = spark.createDataFrame([(-0.0, 1), (0.0, 1), (0.5, 2), (float("nan"), 3), (None, None)], "x double, n int")
    assert all(r["n"] == r["got"] for r in floats.select("n", below([-1.0, -0.0, 2], F.col("x")).alias("got")).collect())


def test_fingerprint_query_has_no_window_over_the_whole_frame(spark, monkeypatch):
    """no plan that the query makes has all rows in one task."""
    from chronoweir.operators import leakage
    from chronoweir.plans.checks import fingerprint_hashes

    plans, made = [], leakage.fingerprint

    def noted(df, *args):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return made(df, *args)

    monkeypatch.setattr(leakage, "fingerprint", noted)
    rows = {r["what"]: (r["same_times"], r["same_values"]) for r in fingerprint_hashes(spark, "/root/testdata/sf0.001").collect()}
    assert rows["values swapped"] == (True, False) and rows["same in another order"] == (True, True)
    assert sum("Window" in p for p in plans) == 1 and all("_run" in p for p in plans if "Window" in p)


def test_duration_mean_adds_a_row_up_twice(spark):
    """a window of very many rows costs no more than a small one; equal times, nulls, times before 1970 and NaN."""
    from pyspark.sql import functions as F

    rows = spark.range(3000).selectExpr("IF(id % 50 = 49, NULL, id * 7919 % 997 - 500) AS t", "id AS k", "id % 3 AS g", "CASE WHEN id % 9 = 0 THEN NULL WHEN id = 700 THEN double('NaN') ELSE id % 13 / 4 END AS value").repartition(4)
    for keys in ((), ("g",)):
        spec = SeriesSpec("t", keys, ["k"])
        for span in (1, 7, 100, 5000):
            want = rows.withColumn("m", features.rolling_mean_duration(rows, spec, "value", span)).orderBy("k").collect()
            made = features.add_duration_mean(rows, spec, "value", span)
            assert made.columns == [*rows.columns, "rolling_mean"]
            for a, b in zip(made.orderBy("k").collect(), want, strict=True):
                assert tuple(a[:3]) == tuple(b[:3])
                assert a["rolling_mean"] == pytest.approx(b["m"], nan_ok=True) if b["m"] is not None else a["rolling_mean"] is None
    one = features.add_duration_mean(spark.range(200).select((F.col("id") % 5).alias("t"), F.lit(1.0).alias("value")), SeriesSpec("t"), "value", 3)
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "RangeFrame" in plan and "RangeFrame, -" not in plan
