"""The library's own queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest, contexts, features, forecast, leakage, scaling, splits
from ..operators.spec import SeriesSpec
from . import audit

CUT, TEST = datetime(2024, 1, 15), datetime(2024, 1, 18)
USER = SeriesSpec("ts", ["user_id"], ["event_id"])
ALL = SeriesSpec("ts", (), ["event_id"])
KEYS = ["user_id", "event_id"]
#: Values of few decimals give exact halves, which two engines may round differently; this moves them off.
OFF_TIES = 0.000000000314

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


W = "PARTITION BY user_id ORDER BY ts, event_id"


def _lags(over: str, ks, c="value", name=None) -> str:
    return ", ".join(f"lag({c}, {k}) OVER ({over}) AS {name or c}_lag_{k}" for k in ks)


def _rolling(over: str, w: int, c="value", name=None) -> str:
    frame = f"({over} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"round(CASE WHEN count({c}) OVER {frame} = {w} THEN avg({c}) OVER {frame} END, 6) AS {name or c}_rolling_{w}"


@query(f"SELECT * FROM (SELECT user_id, event_id, ts, {_lags(W, (1, 7))}, {_rolling(W, 7)} FROM events) WHERE ts > TIMESTAMP '2024-01-15'")
def lag_features(spark, sf_dir):
    made = features.FeatureWindow(USER, [1, 7], [7]).transform(_t(spark, sf_dir, "events").select(*KEYS, "ts", "value"), "value")
    return made.filter(F.col("ts") > F.lit(CUT)).select(*KEYS, "ts", "value_lag_1", "value_lag_7", *_r("value_rolling_7"))


@query(f"SELECT event_id, {_lags('ORDER BY ts, event_id', (0, 1, 30))} FROM events")
def lag_global(spark, sf_dir):
    return features.FeatureWindow(ALL, [0, 1, 30]).transform(_t(spark, sf_dir, "events").select("event_id", "ts", "value"), "value", include_original=True).select("event_id", "value_lag_0", "value_lag_1", "value_lag_30")


@query(f"SELECT user_id, event_id, {_rolling(W, 7)} FROM events")
def rolling_mean_7(spark, sf_dir):
    return _t(spark, sf_dir, "events").select(*KEYS, F.round(features.rolling_mean(USER, "value", 7), 6).alias("value_rolling_7"))


@query(f"SELECT user_id, event_id, {_lags(W, (1, 3))}, {_rolling(W, 5)}, {_lags(W, (1, 3), 'size')}, {_rolling(W, 5, 'size')} FROM (SELECT *, length(props)::BIGINT AS size FROM events)")
def feature_window_multi(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(*KEYS, "ts", "value", F.char_length("props").cast("long").alias("size"))
    made = features.FeatureWindow(USER, [1, 3], [5]).transform(rows, ["value", "size"])
    return made.select(*KEYS, "value_lag_1", "value_lag_3", *_r("value_rolling_5"), "size_lag_1", "size_lag_3", *_r("size_rolling_5"))


@query("SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '7 days' - INTERVAL '1 microsecond' PRECEDING AND CURRENT ROW), 6) AS rolling_mean FROM events")
def rolling_mean_7d(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")
    return rows.select("event_id", "user_id", F.round(features.rolling_mean_duration(rows, USER, "value", "7d"), 6).alias("rolling_mean"))


_EMA = """
WITH x AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT x.user_id, x.event_id, round(sum(y.value * power(0.7, x.i - y.i) * CASE WHEN y.i = 1 THEN 1 ELSE 0.3 END) + 0.000000000314, 6) AS value_ema_03
FROM x JOIN x y ON x.user_id = y.user_id AND y.i <= x.i GROUP BY ALL
"""


@query(_EMA)
def ema_03(spark, sf_dir):
    return _t(spark, sf_dir, "events").select(*KEYS, F.round(features.ema(USER, "value", 0.3) + OFF_TIES, 6).alias("value_ema_03"))


@query(f"SELECT user_id, event_id, round(({' + '.join(f'{7 - k} * lag(value, {k}) OVER ({W})' for k in range(7))}) / 28.0::DOUBLE, 6) AS value_wma_7 FROM events")
def wma_7(spark, sf_dir):
    return _t(spark, sf_dir, "events").select(*KEYS, F.round(features.wma(USER, "value", 7), 6).alias("value_wma_7"))


@query(f"SELECT user_id, event_id, round(avg(value) OVER ({W} ROWS UNBOUNDED PRECEDING), 9) AS value_expanding_mean, round(sum(value) OVER ({W} ROWS UNBOUNDED PRECEDING), 4) AS value_cumulative FROM events")
def expanding_mean(spark, sf_dir):
    return _t(spark, sf_dir, "events").select(*KEYS, F.round(features.expanding_mean(USER, "value"), 9).alias("value_expanding_mean"), F.round(features.cumulative_sum(USER, "value"), 4).alias("value_cumulative"))


@query(f"SELECT user_id, event_id, round(sum(value) OVER ({W} ROWS UNBOUNDED PRECEDING) / count(*) OVER (PARTITION BY user_id), 9) AS value_expanding_mean FROM events")
def expanding_mean_total_length(spark, sf_dir):
    return _t(spark, sf_dir, "events").select(*KEYS, F.round(features.expanding_mean(USER, "value", total_length=True), 9).alias("value_expanding_mean"))


@query("SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events) WHERE i >= 100 AND i < 350")
def row_slice(spark, sf_dir):
    return features.row_slice(_t(spark, sf_dir, "events").select("event_id", "ts", "value"), ALL, 100, 250).select("event_id", "value")


@query("WITH p AS (SELECT median(l_extendedprice) AS c, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS s FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_extendedprice - c) / s, 6) AS scaled FROM lineitem, p")
def robust_scale(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return scaling.scaled(rows, "l_extendedprice", "robust", "scaled").select("l_orderkey", "l_linenumber", *_r("scaled"))


@query("SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS scaled FROM customer")
def standard_scale(spark, sf_dir):
    return scaling.scaled(_t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "standard", "scaled").select("c_custkey", *_r("scaled"))


@query("SELECT event_id, round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 6) AS norm, round(value, 6) AS back FROM events WINDOW w AS (PARTITION BY user_id)")
def normalize_roundtrip(spark, sf_dir):
    rows = scaling.normalize(_t(spark, sf_dir, "events").select("event_id", "user_id", "value"), "value", ["user_id"])
    return rows.select("event_id", F.round("value_norm", 6).alias("norm"), F.round(scaling.denormalize("value_norm"), 6).alias("back"))


_E = "SELECT event_id, ts, value FROM events WHERE "


def _events(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", "ts", "value")


@query(_E + "ts <= TIMESTAMP '2024-01-15'")
def temporal_split_train(spark, sf_dir):
    return splits.temporal_split(_events(spark, sf_dir), "ts", CUT, TEST)[0]


@query(_E + "ts >= TIMESTAMP '2024-01-18'")
def temporal_split_test(spark, sf_dir):
    return splits.temporal_split(_events(spark, sf_dir), "ts", CUT, TEST)[1]


@query(_E + "ts > TIMESTAMP '2024-01-15'")
def temporal_split_after(spark, sf_dir):
    return splits.temporal_split(_events(spark, sf_dir), "ts", CUT)[1]


@query(_E + "ts > TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-18'")
def temporal_split_gap(spark, sf_dir):
    rows = splits.with_masks(_events(spark, sf_dir), "ts", CUT, TEST)
    return rows.filter("not is_train and not is_test").drop("is_train", "is_test")


@query("SELECT o_orderkey, o_orderdate <= TIMESTAMP '1995-06-30' AS is_train, o_orderdate >= TIMESTAMP '1996-01-01' AS is_test FROM orders")
def split_masks(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return splits.with_masks(rows, "o_orderdate", datetime(1995, 6, 30), datetime(1996, 1, 1)).drop("o_orderdate")


@query("SELECT min(ts) AS time_min, max(ts) AS time_max, count(*)::BIGINT AS n_rows, min(ts) <= TIMESTAMP '2024-01-15' AND max(ts) >= TIMESTAMP '2024-01-18' AS covers FROM events")
def temporal_coverage(spark, sf_dir):
    return splits.time_bounds(_t(spark, sf_dir, "events"), "ts").withColumn("covers", (F.col("time_min") <= F.lit(CUT)) & (F.col("time_max") >= F.lit(TEST)))


@query("SELECT (count(*) FILTER (b > o_orderdate))::BIGINT AS n_violations FROM (SELECT o_orderdate, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS b FROM orders)")
def sortedness_violations(spark, sf_dir):
    return splits.sortedness_violations(_t(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey")


@query("SELECT (count(*) FILTER (o_orderdate <= TIMESTAMP '1995-06-30'))::BIGINT AS n_leq, (count(*) FILTER (o_orderdate < TIMESTAMP '1995-06-30'))::BIGINT AS n_lt FROM orders")
def cutoff_counts(spark, sf_dir):
    return splits.cutoff_counts(_t(spark, sf_dir, "orders"), "o_orderdate", datetime(1995, 6, 30))


_FOLDS = """
WITH x AS (SELECT epoch_us(ts) AS t, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events),
f AS (SELECT range AS fold, 2000 + range * 1000 AS cut FROM range((SELECT greatest(0, (count(*) - 2500) // 1000 + 1)::BIGINT FROM x)))
"""


@query(_FOLDS + "SELECT fold, cut::BIGINT AS train_rows, 500::BIGINT AS test_rows, (min(t) FILTER (i >= cut) - max(t) FILTER (i < cut))::BIGINT AS gap FROM f JOIN x ON i < cut + 500 GROUP BY fold, cut")
def expanding_folds(spark, sf_dir):
    return splits.Folds(2000, 500, 1000).statistics(_t(spark, sf_dir, "events"), "ts", ["event_id"])


@query(_FOLDS + "SELECT fold, (count(*) FILTER (i < cut))::BIGINT AS train_rows, (count(*) FILTER (i >= cut))::BIGINT AS test_rows, min(i)::BIGINT AS first_row FROM f JOIN x ON i >= cut - 2000 AND i < cut + 500 GROUP BY fold")
def rolling_folds(spark, sf_dir):
    rows = splits.Folds(2000, 500, 1000, rolling=True).assign(_t(spark, sf_dir, "events").select("ts", "event_id"), "ts", ["event_id"])
    return rows.groupBy("fold").agg(F.count_if(~F.col("is_test")).alias("train_rows"), F.count_if("is_test").alias("test_rows"), F.min("_i").alias("first_row"))


_ERRORS = "round(avg((a - p) * (a - p)), 6) AS mse, round(avg(abs(a - p)), 6) AS mae, round(sqrt(avg((a - p) * (a - p))), 6) AS rmse, round(coalesce(sum(abs((a - p) / nullif(a, 0))), 0) / count(*) * 100, 4) AS mape"


def _backtest(spark, sf_dir, kind, rolling=False):
    found = backtest.native_backtest(_t(spark, sf_dir, "events"), "ts", "value", splits.Folds(2000, 500, 1000, rolling=rolling), kind, ["event_id"])
    return found.select("fold", "train_rows", "test_rows", *_r("mse", "mae", "rmse"), F.round("mape", 4).alias("mape"))


@query(_FOLDS + f"SELECT fold, cut::DOUBLE AS train_rows, count(*)::DOUBLE AS test_rows, {_ERRORS} FROM (SELECT f.fold, f.cut, x.value AS a, y.value AS p FROM f JOIN x ON x.i >= cut AND x.i < cut + 500 JOIN x y ON y.i = cut - 1) GROUP BY fold, cut")
def backtest_last_value(spark, sf_dir):
    return _backtest(spark, sf_dir, "last")


@query(_FOLDS + f"SELECT fold, cut::DOUBLE AS train_rows, count(*)::DOUBLE AS test_rows, {_ERRORS} FROM (SELECT f.fold, f.cut, x.value AS a, (SELECT avg(y.value) FROM x y WHERE y.i < f.cut) AS p FROM f JOIN x ON x.i >= cut AND x.i < cut + 500) GROUP BY fold, cut")
def backtest_mean(spark, sf_dir):
    return _backtest(spark, sf_dir, "mean")


@query(_FOLDS + f"SELECT fold, 2000::DOUBLE AS train_rows, count(*)::DOUBLE AS test_rows, {_ERRORS} FROM (SELECT f.fold, f.cut, x.value AS a, (SELECT avg(y.value) FROM x y WHERE y.i < f.cut AND y.i >= f.cut - 2000) AS p FROM f JOIN x ON x.i >= cut AND x.i < cut + 500) GROUP BY fold, cut")
def backtest_rolling_mean(spark, sf_dir):
    return _backtest(spark, sf_dir, "mean", rolling=True)


@query("WITH d AS (SELECT date_trunc('day', ts) AS day, sum(value) AS v FROM events GROUP BY 1), x AS (SELECT v, row_number() OVER (ORDER BY day) - 1 AS i FROM d), f AS (SELECT range AS fold, 14 + range * 3 AS cut FROM range((SELECT least(4, greatest(0, (count(*) - 17) // 3 + 1))::BIGINT FROM x))) " + f"SELECT fold, cut::DOUBLE AS train_rows, count(*)::DOUBLE AS test_rows, {_ERRORS.replace('6)', '4)')} FROM (SELECT f.fold, f.cut, x.v AS a, y.v AS p FROM f JOIN x ON x.i >= cut AND x.i < cut + 3 JOIN x y ON y.i = cut - 7 + x.i - cut) GROUP BY fold, cut")
def backtest_model(spark, sf_dir):
    daily = _t(spark, sf_dir, "events").groupBy(F.date_trunc("day", F.col("ts")).alias("day")).agg(F.sum("value").alias("v"))
    found = backtest.BacktestRunner(3, 3, 4).run_expanding_window(forecast.SeasonalNaive(7), daily, "day", "v", 14)
    return found.select("fold", "train_rows", "test_rows", *(F.round(c, 4).alias(c) for c in ("mse", "mae", "rmse", "mape")))


@query("SELECT 'events' AS name, count(*)::BIGINT AS n_rows, epoch_us(min(ts))::BIGINT AS time_min, epoch_us(max(ts))::BIGINT AS time_max FROM events")
def fingerprint_bounds(spark, sf_dir):
    return leakage.fingerprint(_t(spark, sf_dir, "events"), "ts", "value", "events", ["event_id"]).drop("time_hash", "value_hash")


_SCORES = """
WITH p AS (SELECT event_type, ts <= TIMESTAMP '2024-01-15' AS train, count(*) AS n, min(ts) AS lo, max(ts) AS hi, list(value ORDER BY ts, event_id) AS vs, list(ts ORDER BY ts, event_id) AS ss FROM events GROUP BY ALL)
SELECT b.event_type AS test_name, a.event_type AS train_name, CASE WHEN a.vs = b.vs AND a.ss = b.ss THEN 1.0 WHEN a.hi < b.lo OR b.hi < a.lo THEN 0.0 WHEN a.vs = b.vs THEN 0.95 ELSE 0.5 END::DOUBLE AS similarity
FROM p a, p b WHERE a.train
"""


@query(_SCORES)
def leakage_similarity(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("train", F.col("ts") <= F.lit(CUT))
    prints = leakage.grouped_fingerprints(rows, SeriesSpec("ts", ["event_type", "train"], ["event_id"]), "value").withColumnRenamed("event_type", "name")
    return leakage.scores(prints.filter("train"), prints)


@query("WITH k AS (SELECT DISTINCT ts, value FROM events WHERE ts <= TIMESTAMP '2024-01-18'), t AS (SELECT ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-15') SELECT count(*)::BIGINT AS n_test, count(k.ts)::BIGINT AS n_matching, count(k.ts) / count(*)::DOUBLE AS share FROM t LEFT JOIN k ON t.ts = k.ts AND t.value = k.value")
def pair_overlap(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")
    return leakage.pair_overlap(rows.filter(F.col("ts") <= F.lit(TEST)), rows.filter(F.col("ts") >= F.lit(CUT)), "ts", "value")


@query("WITH x AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT a.user_id, a.i::BIGINT AS start, (b.i - a.i)::INT AS step, b.value FROM x a JOIN x b ON a.user_id = b.user_id AND b.i >= a.i AND b.i < a.i + 8 WHERE a.i % 4 = 0 AND a.i + 8 <= a.n")
def context_windows(spark, sf_dir):
    return contexts.context_rows(_t(spark, sf_dir, "events"), USER, "value", 8, 4)


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 16")
def latest_context(spark, sf_dir):
    return contexts.latest_context(_t(spark, sf_dir, "events").select(*KEYS, "ts", "value"), USER, 16).drop("ts")


@query("SELECT event_id, ((row_number() OVER (ORDER BY ts, event_id) - 1) // 64)::BIGINT AS batch_id FROM events")
def batch_ids(spark, sf_dir):
    return contexts.batch_ids(_t(spark, sf_dir, "events").select("event_id", "ts"), ALL, 64).drop("ts")


@query("SELECT user_id, round(0.25 * arg_max(value, (ts, event_id)) + 0.75 * avg(value), 6) AS point, round(0.9 * (0.25 * arg_max(value, (ts, event_id)) + 0.75 * avg(value)), 6) AS lower, round(1.1 * (0.25 * arg_max(value, (ts, event_id)) + 0.75 * avg(value)), 6) AS upper, 0.95::DOUBLE AS confidence FROM events GROUP BY user_id")
def ensemble_forecast(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")
    both = [forecast.native_baseline(rows, USER, "value", k).withColumn("model", F.lit(k)) for k in ("last", "mean")]
    found = forecast.EnsemblePredictor(["last", "mean"], [0.25, 0.75]).combine(both[0].unionByName(both[1]), ["user_id"])
    return found.select("user_id", *_r("point", "lower", "upper"), "confidence")


@query("SELECT user_id, round(arg_max(value, (ts, event_id)), 6) AS first_step, 3::INT AS steps, 0.95::DOUBLE AS confidence FROM events GROUP BY user_id")
def batch_forecast(spark, sf_dir):
    found = forecast.BatchPredictor(USER, "value").predict_batch(forecast.LastValue(), _t(spark, sf_dir, "events"), 3)
    return found.select("user_id", F.round(F.col("point")[0], 6).alias("first_step"), F.size("point").alias("steps"), "confidence")


@query("WITH p AS (SELECT avg(l_quantity) FILTER (l_shipdate <= TIMESTAMP '1995-06-30') AS a, avg(l_quantity) FILTER (l_shipdate > TIMESTAMP '1995-06-30') AS b, stddev_pop(l_quantity) FILTER (l_shipdate <= TIMESTAMP '1995-06-30') AS c, stddev_pop(l_quantity) FILTER (l_shipdate > TIMESTAMP '1995-06-30') AS d FROM lineitem) SELECT round(abs(b - a) / abs(a), 6) AS mean_shift, round(abs(d - c) / c, 6) AS std_shift, abs(b - a) / abs(a) < 0.1 AND abs(d - c) / c < 0.1 AS similar FROM p")
def distribution_similarity(spark, sf_dir):
    train = F.col("l_shipdate") <= F.lit(datetime(1995, 6, 30))
    return _t(spark, sf_dir, "lineitem").agg(*audit.distribution_similarity(train, ~train, F.col("l_quantity"), 0.1)).select(*_r("mean_shift", "std_shift"), "similar")


@query("SELECT strftime(max(o_orderdate) FILTER (o_orderdate <= TIMESTAMP '1995-06-30'), '%Y-%m-%d') AS train_last, strftime(min(o_orderdate) FILTER (o_orderdate > TIMESTAMP '1995-06-30'), '%Y-%m-%d') AS test_first, true AS ordered FROM orders")
def string_date_leakage(spark, sf_dir):
    train = F.col("o_orderdate") <= F.lit(datetime(1995, 6, 30))
    return audit.date_order(_t(spark, sf_dir, "orders"), train, ~train, F.date_format("o_orderdate", "yyyy-MM-dd"))
