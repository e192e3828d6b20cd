"""Queries over the objects of the library: lists, detectors, validators, bridges, models, pipelines and reports. Each has the SQL that gives the same rows."""

from __future__ import annotations

import json
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics, tensors
from ..operators import backtest, contexts, features, forecast, leakage, scaling, splits
from ..operators.spec import SeriesSpec
from ..sources import frames
from . import audit, managed
from .catalog import ALL, CUT, OFF_TIES, TEST, USER, W, _events, _lags, _r, _rolling, _t, query

TYPE = SeriesSpec("ts", ["event_type"], ["event_id"])
_DAYS = "d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, round(sum(value), 4) AS v FROM events GROUP BY 1), x AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM d)"
_NUMBERED = "x AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


def _daily(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.round(F.sum("value"), 4).alias("v"))


def _days(spark, sf_dir) -> list[tuple[datetime, float]]:
    """The daily sums as a list, as long as there are days."""
    return [tuple(r) for r in _daily(spark, sf_dir).orderBy("day").collect()]


def _outcome(f) -> str:
    try:
        f()
    except (ValueError, TypeError, KeyError, MemoryError, RuntimeError, NotImplementedError) as e:
        return f"{type(e).__name__}: {e.args[0]}"
    return "passed"


@query(f"WITH {_DAYS} SELECT i::BIGINT AS seq, {_lags('ORDER BY i', (0, 1, 3), 'v', 'list')}, {_rolling('ORDER BY i', 3, 'v', 'list')} FROM x")
def list_window(spark, sf_dir):
    found = frames.ListWindow(spark, [0, 1, 3], [3]).transform([v for _, v in _days(spark, sf_dir)], include_rolling=True)
    rows = [(i, *r) for i, r in enumerate(zip(*found, strict=True))]
    return spark.createDataFrame(rows, "seq long, list_lag_0 double, list_lag_1 double, list_lag_3 double, m double").select("seq", "list_lag_0", "list_lag_1", "list_lag_3", F.round("m", 6).alias("list_rolling_3"))


@query(f"WITH {_DAYS} SELECT i::BIGINT AS seq, {_rolling('ORDER BY i', 5, 'v', 'list')} FROM x")
def list_rolling_mean(spark, sf_dir):
    found = frames.ListWindow(spark, []).rolling_mean([v for _, v in _days(spark, sf_dir)], 5)
    return spark.createDataFrame(list(enumerate(found)), "seq long, m double").select("seq", F.round("m", 6).alias("list_rolling_5"))


@query(f"SELECT user_id, ts, event_id, lag(value, 3) OVER ({W}) AS value FROM events")
def lag_strict(spark, sf_dir):
    return features.generate_lag(_t(spark, sf_dir, "events"), USER, "value", 3)


@query(f"SELECT {_lags(W, (1, 2))}, {_rolling(W, 3)} FROM events")
def features_alone(spark, sf_dir):
    made = features.feature_window(USER, [1, 2], [3]).transform(_t(spark, sf_dir, "events"), "value", include_original=False)
    return made.select("value_lag_1", "value_lag_2", *_r("value_rolling_3"))


@query(f"WITH {_DAYS} SELECT day, {_lags('ORDER BY day', (1, 2), 'v')} FROM x")
def arrow_lags(spark, sf_dir):
    table = _daily(spark, sf_dir).orderBy("day").toArrow()
    rows = frames.from_arrow(spark, table)
    return features.FeatureWindow(SeriesSpec("seq"), [1, 2]).transform(rows, "v").select("day", "v_lag_1", "v_lag_2")


@query("SELECT o_orderstatus, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def dataset_uri(spark, sf_dir):
    job = managed.BacktestJob(f"{sf_dir}/orders.parquet", "o_totalprice", "o_orderdate")
    rows = frames.read(spark, job.payload()["dataset_uri"])
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum(job.target_col), 2).alias("total"))


@query("SELECT event_id, round(avg(value) OVER (ORDER BY ts RANGE BETWEEN INTERVAL '1 hour' - INTERVAL '1 microsecond' PRECEDING AND CURRENT ROW), 6) AS rolling_mean FROM events")
def rolling_mean_1h_global(spark, sf_dir):
    return features.add_duration_mean(_events(spark, sf_dir), ALL, "value", "1h").select("event_id", *_r("rolling_mean"))


@query("SELECT event_id, round(sum(value) OVER w, 4) AS value_cumulative, round(avg(value) OVER w, 6) AS value_expanding_mean FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def expanding_global(spark, sf_dir):
    return features.add_expanding(_events(spark, sf_dir), ALL, "value").select("event_id", F.round("value_cumulative", 4).alias("value_cumulative"), *_r("value_expanding_mean"))


@query("SELECT * FROM (VALUES ('frame guard', 'TypeError: expected a Spark DataFrame, got list'), ('column guard', 'ValueError: Column ''nope'' not found'), ('arrow guard', 'TypeError: expected an Arrow table, got list'), ('negative lag', 'ValueError: Lags must be non-negative'), ('rolling window', 'ValueError: window must be positive'), ('alpha', 'ValueError: alpha must be in the interval (0, 1]'), ('bounds', 'ValueError: Test start must be after train end (temporal leakage detected!)'), ('weights', 'ValueError: Weights must match number of models'), ('step type', 'ValueError: Unknown step type: other'), ('no cutoff', 'ValueError: temporal_cutoff not configured'), ('memory', 'MemoryError: 10 bytes asked for, 5 free'), ('pipeline', 'ValueError: Pipeline not fitted'), ('text values', 'TypeError: Column ''event_type'' of type string can''t be fingerprinted'), ('short series', 'ValueError: Need at least 1000000 rows, got 5'), ('start', 'ValueError: Invalid start -1'), ('client', 'RuntimeError: no client to submit the job with')) t(what, outcome)")
def argument_errors(spark, sf_dir):
    rows = _events(spark, sf_dir)
    few, bridge = spark.range(5).withColumn("value", F.lit(1.0)), contexts.ContextBridge(SeriesSpec("id"), "value", 1_000_000)

    def reserve():
        with tensors.MemoryGuard.reserve(10, cap=5):
            pass

    cases = {
        "frame guard": lambda: splits.temporal_split([1], "ts", CUT),
        "column guard": lambda: splits.temporal_split(rows, "nope", CUT),
        "arrow guard": lambda: frames.from_arrow(spark, [1]),
        "negative lag": lambda: features.FeatureWindow(ALL, [-1]),
        "rolling window": lambda: features.FeatureWindow(ALL, rolling=[0]),
        "alpha": lambda: features.FeatureWindow(ALL, alphas=[1.5]),
        "bounds": lambda: splits.validate_bounds(TEST, CUT),
        "weights": lambda: forecast.EnsemblePredictor(["a"], [0.5, 0.5]),
        "step type": lambda: managed.ManagedPipeline("p").add_step("s", "other").execute(rows),
        "no cutoff": lambda: managed.ManagedPipeline("p").add_step("s").execute(rows),
        "memory": reserve,
        "pipeline": lambda: scaling.Pipeline([]).transform(rows),
        "text values": lambda: leakage.fingerprint(_t(spark, sf_dir, "events"), "ts", "event_type", "x"),
        "short series": lambda: bridge.latest_context(few),
        "start": lambda: bridge.context_view(few, -1),
        "client": lambda: managed.BacktestJob("x", "value", "ts").submit(),
    }
    return spark.createDataFrame([(k, _outcome(f)) for k, f in cases.items()], "what string, outcome string")


@query("SELECT * FROM (VALUES ('list window', 'ListWindow(lags=[1, 7], rolling=[3])'), ('validator', 'TemporalValidator(train_end=1, test_start=3)'), ('ensemble', 'EnsemblePredictor(models=[''a'', ''b''], weights=[0.5, 0.5])'), ('runner', 'BacktestRunner(test_size=30, step_size=1, n_splits=5)'), ('converter', 'TensorConverter(dtype=''float32'')'), ('accelerator', 'Accelerator(device=''cuda:0'', batch_size=32)'), ('pipeline', 'ManagedPipeline(id=''p'', steps=1)'), ('scheduler', 'ValidationScheduler(pipeline_id=''p'', schedule=''daily'')'), ('compliance', 'ComplianceChecker(rules=5)'), ('logger', 'AuditLogger(log_file=''a.log'', entries=1)'), ('report', 'ReportGenerator(template=''default'')'), ('chronos', 'FoundationModel(''chronos:load'', context_length=512, prediction_length=64)'), ('lag-llama', 'FoundationModel(''lag_llama:load'', context_length=32, prediction_length=1)'), ('moirai', 'FoundationModel(''moirai:load'', context_length=512, prediction_length=128)')) t(what, shown)")
def object_reprs(spark, sf_dir):
    validator, checker, log = splits.TemporalValidator(), audit.ComplianceChecker(), audit.AuditLogger("a.log")
    validator.set_split(1, 3)
    checker.add_rule("more", "one more")
    log.log("x")
    shown = {
        "list window": frames.ListWindow(spark, [1, 7], [3]),
        "validator": validator,
        "ensemble": forecast.EnsemblePredictor(["a", "b"]),
        "runner": backtest.BacktestRunner(),
        "converter": tensors.TensorConverter(),
        "accelerator": tensors.Accelerator(),
        "pipeline": managed.ManagedPipeline("p").add_validation_step("s"),
        "scheduler": managed.ValidationScheduler("p"),
        "compliance": checker,
        "logger": log,
        "report": audit.ReportGenerator(),
        **{k: forecast.zero_shot_loader(k) for k in ("chronos", "lag-llama", "moirai")},
    }
    return spark.createDataFrame([(k, repr(v)) for k, v in shown.items()], "what string, shown string")


@query(f"WITH {_DAYS} SELECT day, day <= TIMESTAMP '2024-01-15' AS is_train, day >= TIMESTAMP '2024-01-18' AS is_test, day <= TIMESTAMP '2024-01-15' AS allowed, day + INTERVAL '1 microsecond' AS following FROM x")
def list_split(spark, sf_dir):
    days = [d for d, _ in _days(spark, sf_dir)]
    splitter = splits.TemporalSplitter()
    train, test = splitter.split(days, CUT, TEST)
    allowed = [_outcome(lambda d=d: splitter.validate_feature(d)) == "passed" for d in days]
    rows = [(d, a, b, c, splits.datetime_after(d)) for d, a, b, c in zip(days, train, test, allowed, strict=True)]
    return spark.createDataFrame(rows, "day timestamp_ntz, is_train boolean, is_test boolean, allowed boolean, following timestamp_ntz")


@query("SELECT (count(*) FILTER (ts <= TIMESTAMP '2024-01-15'))::BIGINT AS n_train, (count(*) FILTER (ts >= TIMESTAMP '2024-01-18'))::BIGINT AS n_test, true AS covered, max(ts) <= TIMESTAMP '2024-01-15' AS whole_frame_allowed, true AS train_allowed FROM events")
def validator_wrapper(spark, sf_dir):
    rows, v = _events(spark, sf_dir), splits.TemporalValidator()
    v.set_split(CUT, TEST)
    train, test = v.split(rows, "ts", CUT, TEST)
    outcome = v.validate_split(rows, "ts", CUT, TEST), _outcome(lambda: v.check_frame(rows, "ts")) == "passed", v.check_frame(train, "ts")
    return spark.createDataFrame([(train.count(), test.count(), *outcome)], "n_train long, n_test long, covered boolean, whole_frame_allowed boolean, train_allowed boolean")


@query("SELECT * FROM (VALUES ('same in another order', true, true), ('one value changed', true, false), ('one time changed', false, true), ('values swapped', true, false)) t(what, same_times, same_values)")
def fingerprint_hashes(spark, sf_dir):
    rows = _events(spark, sf_dir)
    ends = F.struct("ts", "event_id", "value")
    first, last = rows.agg(F.min(ends), F.max(ends)).first()
    mine, value = F.col("event_id") == first["event_id"], F.col("value")
    # every value goes one row on, and the last to the first
    turned = features.FeatureWindow(ALL, [1]).transform(rows, "value")
    cases = {
        "same in another order": rows.repartition(7, "value"),
        "one value changed": rows.withColumn("value", F.when(mine, value + 1).otherwise(value)),
        "one time changed": rows.withColumn("ts", F.when(mine, F.col("ts") - F.expr("INTERVAL '1' SECOND")).otherwise(F.col("ts"))),
        "values swapped": turned.select("event_id", "ts", F.when(mine, F.lit(last["value"])).otherwise(F.col("value_lag_1")).alias("value")),
    }
    of = lambda df, name: leakage.fingerprint(df, "ts", "value", name, ["event_id"])
    base = of(rows, "base").first()
    found = [(k, of(df, k).first()) for k, df in cases.items()]
    return spark.createDataFrame([(k, r["time_hash"] == base["time_hash"], r["value_hash"] == base["value_hash"]) for k, r in found], "what string, same_times boolean, same_values boolean")


def _detected(spark, sf_dir):
    """A detector with the first half of the daily sums, and frames to check."""
    days = _daily(spark, sf_dir).withColumn("v", F.col("v") + F.dayofyear("day"))
    train, t = days.filter(F.col("day") <= F.lit(CUT)), F.col("day")
    return train, {"same": train, "later": days.filter(t > F.lit(TEST)), "overlapping": days.filter(t >= F.lit(datetime(2024, 1, 10))), "moved": train.withColumn("day", t + F.expr("INTERVAL '1' HOUR"))}


@query("SELECT * FROM (VALUES ('same', 'train', 1.0::DOUBLE, false), ('later', 'train', 0.0, true), ('overlapping', 'train', 0.5, false), ('moved', 'train', 0.95, false)) t(test_name, train_name, similarity, allowed)")
def detector_frames(spark, sf_dir):
    detector = leakage.LeakageDetector(0.1)
    train, cases = _detected(spark, sf_dir)
    detector.register_training_frame(train, "day", "v", "train")
    scored = [tuple(detector.score_frame(df, "day", "v", k).first()) for k, df in cases.items()]
    allowed = {k: _outcome(lambda k=k, df=df: detector.check_test_frame(df, "day", "v", k)) == "passed" for k, df in cases.items()}
    assert set(detector.get_report()) == {k for k, ok in allowed.items() if not ok}
    return spark.createDataFrame([(*r, allowed[r[0]]) for r in scored], "test_name string, train_name string, similarity double, allowed boolean")


@query(f"WITH {_DAYS}, s AS (SELECT count(*) FILTER (day >= TIMESTAMP '2024-01-10' AND day <= TIMESTAMP '2024-01-15') / (count(*) FILTER (day >= TIMESTAMP '2024-01-10'))::DOUBLE AS share FROM x) SELECT 'same' AS name, 'exact' AS outcome, NULL::DOUBLE AS share UNION ALL SELECT 'later', 'passed', NULL UNION ALL SELECT 'overlapping', 'shared', round(share, 6) FROM s UNION ALL SELECT 'moved', 'passed', NULL")
def detector_features(spark, sf_dir):
    detector = leakage.LeakageDetector(0.1)
    train, cases = _detected(spark, sf_dir)
    detector.register_training_feature(train, "day", "v", "train")
    rows = []
    for k, df in cases.items():
        said = _outcome(lambda k=k, df=df: detector.check_test_feature(df, "day", "v", k))
        outcome = "passed" if said == "passed" else "exact" if "EXACT" in said else "shared"
        rows.append((k, outcome, round(dict(detector.get_report().get(k, [])).get("train"), 6) if outcome == "shared" else None))
    return spark.createDataFrame(rows, "name string, outcome string, share double")


@query("WITH a AS (SELECT event_type, ts <= TIMESTAMP '2024-01-20' AS train, ts, event_id, floor(value)::INT % 3 AS v, ts >= TIMESTAMP '2024-01-10' AS test FROM events), tr AS (SELECT DISTINCT list(v) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS c FROM a WHERE train AND event_type = 'view'), te AS (SELECT list(v) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS c, row_number() OVER (ORDER BY ts, event_id) - 1 AS start FROM a WHERE test AND event_type = 'view') SELECT start::BIGINT AS start FROM te WHERE len(c) = 6 AND c IN (SELECT c FROM tr WHERE len(c) = 6)")
def window_overlap(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").filter("event_type = 'view'").select("ts", "event_id", (F.floor("value").cast("int") % 3).alias("v"))
    return leakage.window_overlap(rows.filter(F.col("ts") <= F.lit(datetime(2024, 1, 20))), rows.filter(F.col("ts") >= F.lit(datetime(2024, 1, 10))), ALL, "v", 6)


@query("WITH x AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS context FROM events) SELECT user_id, i::BIGINT AS start, context[1] AS first, context[8] AS last, round(list_sum(context), 6) AS total FROM x WHERE i % 3 = 0 AND i + 8 <= n")
def context_arrays(spark, sf_dir):
    found = contexts.contexts(_t(spark, sf_dir, "events"), USER, "value", 8, 3)
    total = F.aggregate("context", F.lit(0.0), lambda a, x: a + x)
    return found.select("user_id", "start", F.col("context")[0].alias("first"), F.col("context")[7].alias("last"), F.round(total, 6).alias("total"))


@query(f"WITH {_NUMBERED} SELECT event_type, event_id, value FROM x WHERE i >= 20 AND i < 52")
def context_view(spark, sf_dir):
    return contexts.ContextBridge(TYPE, "value", 32).context_view(_t(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value"), 20).drop("ts")


@query(f"WITH {_NUMBERED} SELECT event_type, round(avg(value) + 0.000000000314, 6) AS step_1, 3 AS steps FROM x WHERE i >= n - 32 GROUP BY event_type")
def bridge_predict(spark, sf_dir):
    found = contexts.ContextBridge(TYPE, "value", 32, 3).predict(forecast.MeanValue(), _t(spark, sf_dir, "events"))
    return found.select("event_type", F.round(F.col("forecast")[0] + OFF_TIES, 6).alias("step_1"), F.size("forecast").alias("steps"))


@query(f"WITH {_NUMBERED}, c AS (SELECT *, avg(value) OVER w AS m, last_value(value) OVER w AS z FROM x WINDOW w AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING)) SELECT event_type, i::BIGINT AS start, round(m + 0.000000000314, 6) AS mean_step, z AS last_step FROM c WHERE i % 16 = 0 AND i + 32 <= n")
def predict_stream(spark, sf_dir):
    rows = contexts.contexts(_t(spark, sf_dir, "events"), TYPE, "value", 32, 16)
    mean = contexts.ContextBridge(TYPE, "value", 32, 2, 16).predict_batch(forecast.MeanValue(), _t(spark, sf_dir, "events"))
    last = forecast.BatchPredictor(TYPE, "value").predict_stream(forecast.LastValue(), rows, 2, 5)
    both = mean.join(last, ["event_type", "start"])
    return both.select("event_type", "start", F.round(F.col("forecast")[0] + OFF_TIES, 6).alias("mean_step"), F.col("point")[1].alias("last_step"))


@query(f"WITH {_NUMBERED}, c AS (SELECT *, max(value::FLOAT) OVER w AS m FROM x WINDOW w AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING)) SELECT event_type, i::BIGINT AS start, m::DOUBLE AS step_1, 2 AS steps FROM c WHERE i % 16 = 0 AND i + 32 <= n")
def forward_batches(spark, sf_dir):
    rows = contexts.contexts(_t(spark, sf_dir, "events"), TYPE, "value", 32, 16)
    found = forecast.forward_batches(rows, lambda block, horizon: np.repeat(block.max(1)[:, None], horizon, 1), 2, 7)
    return found.select("event_type", "start", F.col("point")[0].alias("step_1"), F.size("point").alias("steps"))


class RowsSeen:
    """Forecasts how many rows it has been fitted on in all its life."""

    def __init__(self):
        self.n = 0

    def fit(self, train):
        self.n += len(train)

    def predict(self, train, horizon):
        return [float(self.n)] * horizon


@query("SELECT user_id, count(*)::DOUBLE AS seen FROM events GROUP BY user_id")
def batch_forecast_stateful(spark, sf_dir):
    found = forecast.BatchPredictor(USER, "value").predict_batch(RowsSeen(), _t(spark, sf_dir, "events"), 1)
    return found.select("user_id", F.col("point")[0].alias("seen"))


@query("SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS standard, round((value - (SELECT median(value) FROM events)) / (SELECT quantile_cont(value, 0.75) - quantile_cont(value, 0.25) FROM events), 6) AS robust FROM events")
def fitted_pipelines(spark, sf_dir):
    rows = _events(spark, sf_dir)
    made = [scaling.Pipeline([scaling.Scale(m, "value")]).fit_transform(rows).select("event_id", F.round("value", 6).alias(m)) for m in ("standard", "robust")]
    return made[0].join(made[1], "event_id")


_ROLL = "f AS (SELECT range AS fold, 14 + range * 3 AS cut FROM range((SELECT least(4, greatest(0, (count(*) - 17) // 3 + 1))::BIGINT FROM x)))"


@query(f"WITH {_DAYS}, {_ROLL} SELECT f.fold, (x.i - cut)::INT AS step, round(x.v - y.v, 4) AS residual FROM f JOIN x ON x.i >= cut AND x.i < cut + 3 JOIN x y ON y.i = cut - 7 + x.i - cut")
def backtest_residuals(spark, sf_dir):
    found = backtest.BacktestRunner(3, 3, 4).run_expanding_window(forecast.SeasonalNaive(7), _daily(spark, sf_dir), "day", "v", 14, details=True)
    return found.select("fold", F.posexplode("residuals").alias("step", "r")).select("fold", "step", F.round("r", 4).alias("residual"))


@query(f"WITH {_DAYS}, {_ROLL} SELECT fold, 14::DOUBLE AS train_rows, 3::DOUBLE AS test_rows, round(avg(abs(a - p)), 4) AS mae FROM (SELECT f.fold, x.v AS a, (SELECT avg(y.v) FROM x y WHERE y.i >= cut - 14 AND y.i < cut) AS p FROM f JOIN x ON x.i >= cut AND x.i < cut + 3) GROUP BY fold")
def backtest_model_rolling(spark, sf_dir):
    found = backtest.BacktestRunner(3, 3, 4).run_rolling_window(forecast.MeanValue(), _daily(spark, sf_dir), "day", "v", 14)
    return found.select("fold", "train_rows", "test_rows", F.round("mae", 4).alias("mae"))


@query(f"WITH {_DAYS} SELECT round(avg((v - p) * (v - p)), 2) AS mse, round(avg(abs(v - p)), 4) AS mae, round(sqrt(avg((v - p) * (v - p))), 4) AS rmse, round(avg(abs((v - p) / v)) * 100, 4) AS mape FROM (SELECT v, lag(v) OVER (ORDER BY i) AS p FROM x) WHERE p IS NOT NULL")
def list_errors(spark, sf_dir):
    values = [v for _, v in _days(spark, sf_dir)]
    m = metrics.list_metrics(values[:-1], values[1:])
    return spark.createDataFrame([tuple(m[k] for k in ("mse", "mae", "rmse", "mape"))], "mse double, mae double, rmse double, mape double").select(F.round("mse", 2).alias("mse"), *(F.round(c, 4).alias(c) for c in ("mae", "rmse", "mape")))


@query(f"WITH {_DAYS} SELECT round(0.25 * arg_max(v, i) + 0.75 * avg(v), 4) AS point, round(0.9 * (0.25 * arg_max(v, i) + 0.75 * avg(v)), 4) AS lower, round(1.1 * (0.25 * arg_max(v, i) + 0.75 * avg(v)), 4) AS upper FROM x")
def ensemble_list(spark, sf_dir):
    models = {"last": forecast.LastValue(), "mean": forecast.MeanValue()}
    f = forecast.EnsemblePredictor(list(models), [0.25, 0.75]).predict(models, [v for _, v in _days(spark, sf_dir)], 1)
    return spark.createDataFrame([(f.point[0], f.lower[0], f.upper[0])], "p double, l double, u double").select(*(F.round(a, 4).alias(b) for a, b in zip("plu", ("point", "lower", "upper"), strict=True)))


@query(f"WITH {_DAYS} SELECT i::BIGINT AS start, v AS first, lead(v, 6) OVER (ORDER BY i) AS last FROM x QUALIFY lead(v, 6) OVER (ORDER BY i) IS NOT NULL")
def context_matrix(spark, sf_dir):
    found = forecast.FoundationModel("json:loads", 7).prepare_input([v for _, v in _days(spark, sf_dir)])
    return spark.createDataFrame([(i, c[0], c[-1]) for i, c in enumerate(found)], "start long, first double, last double")


@query(f"WITH {_DAYS} SELECT n::BIGINT AS n, round(sum(v), 2) AS total, 2 AS rows, round(sum(v) FILTER (i < 6), 2) AS head FROM x GROUP BY n")
def tensor_bridge(spark, sf_dir):
    view = tensors.TensorBridge("float64").numpy_view(_daily(spark, sf_dir).orderBy("day"), "v")
    convert = tensors.TensorConverter("float64")
    matrix = convert.to_tensor_2d([view[:3], view[3:6]])
    sums = tensors.Accelerator(batch_size=1).infer(lambda b: b.sum(1), convert.reshape(convert.to_tensor(view[:6]), (2, 3)))
    assert len(sums) == len(matrix) and np.allclose(sums, matrix.sum(1), rtol=1e-5)
    return spark.createDataFrame([(len(view), float(view.sum()), len(matrix), float(matrix.sum()))], "n long, t double, rows int, h double").select("n", F.round("t", 2).alias("total"), "rows", F.round("h", 2).alias("head"))


@query("SELECT 'orders' AS report_id, true AS passed, 2::BIGINT AS checks, 1::BIGINT AS warnings, count(*)::DOUBLE AS n_rows, true AS as_html, count(*)::DOUBLE AS n_rows_json FROM orders")
def audit_report(spark, sf_dir):
    rows, report = _t(spark, sf_dir, "orders"), audit.AuditReport("orders")
    report.add_validation("sorted by key", splits.sortedness_violations(rows, "o_orderkey", "o_orderkey").first()[0] == 0)
    report.add_validation("has rows", not rows.isEmpty())
    report.add_metric("n_rows", rows.count())
    report.add_warning("dates < keys")
    page, said = audit.ReportGenerator().generate_html(report), json.loads(report.to_json())
    assert report.finalize()["checks"] == "2"
    whole = "PASSED" in page and "dates &lt; keys" in page
    found = report.to_frame(spark).select("report_id", "passed", F.size("validation_checks").cast("long").alias("checks"), F.size("warnings").cast("long").alias("warnings"), F.col("metrics")["n_rows"].alias("n_rows"))
    return found.withColumns({"as_html": F.lit(whole), "n_rows_json": F.lit(said["metrics"]["n_rows"])})


@query("WITH d AS (SELECT DISTINCT o_orderdate <= TIMESTAMP '1995-06-30' AS train FROM orders) SELECT 'in order' AS what, true AS passed, 100.0::DOUBLE AS score, 0 AS warnings UNION ALL SELECT 'swapped', false, 0.0, 1")
def compliance_run(spark, sf_dir):
    dates = _t(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).distinct()
    # one string a day
    train, test = ([r[0] for r in dates.filter(c).collect()] for c in (F.col("d") <= "1995-06-30", F.col("d") > "1995-06-30"))
    checker = audit.ComplianceChecker()
    found = [(k, checker.run_compliance_check({"train_dates": a, "test_dates": b})) for k, a, b in (("in order", train, test), ("swapped", test, train))]
    return spark.createDataFrame([(k, r.passed, r.metrics["compliance_score"], len(r.warnings)) for k, r in found], "what string, passed boolean, score double, warnings int")


@query("SELECT event_id, value, 'train' AS side FROM events WHERE ts <= TIMESTAMP '2024-01-15' UNION ALL SELECT event_id, value, 'test' FROM events WHERE ts >= TIMESTAMP '2024-01-18' UNION ALL SELECT event_id, value, 'managed' FROM events WHERE ts <= TIMESTAMP '2024-01-15'")
def managed_pipelines(spark, sf_dir):
    rows = _events(spark, sf_dir)
    found = managed.ValidationPipeline("p").add_temporal_split("ts", CUT, TEST).run(rows)
    assert found["audit"].summary["passed"] == "true"
    pipeline = managed.ManagedPipeline("m").add_step("columns", "feature_validation").add_step("cut")
    pipeline.set_config("required_columns", ["value"]).set_config("time_col", "ts").set_config("temporal_cutoff", CUT)
    sides = {"train": found["artifacts"]["train"], "test": found["artifacts"]["test"], "managed": pipeline.run(rows)}
    parts = [df.select("event_id", "value", F.lit(k).alias("side")) for k, df in sides.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT * FROM (VALUES ('status', '{"pipeline_id": "p", "steps": "1", "status": "ready"}'), ('schedule', '"Pipeline ''p'' scheduled: 0 0 * * 0"'), ('registry', '["a", "{}", true, null]'), ('payload', '{"dataset_uri": "s3://bucket/x", "target_col": "value", "time_col": "ts", "format": "arrow_or_parquet", "zero_copy_required": true}'), ('config', '{"function": "backtest", "timeout": 300, "memory_mb": 3008}'), ('sent', '["backtest", 5]'), ('gpu', '{"error": "GPU not available"}'), ('log', '["INFO - one", "WARN - two"]')) t(what, said)""")
def service_objects(spark, sf_dir):
    registry, log, job = managed.PipelineRegistry(), audit.AuditLogger(), managed.BacktestJob("s3://bucket/x", "value", "ts")
    registry.register("a", "{}")
    held = [*registry.list_pipelines(), registry.get("a"), registry.delete("a"), registry.get("a")]
    log.log("one"), log.log("two", "WARN")
    said = {
        "status": managed.ManagedPipeline("p").add_step("s").get_status(),
        "schedule": managed.ValidationScheduler("p", "weekly").schedule_run(),
        "registry": held,
        "payload": job.payload(),
        "config": job.payload(with_config=True)["config"],
        "sent": job.submit(lambda function, body: [function, len(json.loads(body))]),
        "gpu": tensors.Accelerator().stats(),
        "log": [x.split("] ")[1] for x in log.get_logs()],
    }
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in said.items()], "what string, said string")


