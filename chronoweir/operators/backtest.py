"""Backtests over expanding and rolling folds."""

from __future__ import annotations

import copy
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import error_aggregates, list_metrics
from .spec import require
from .splits import Folds

METRICS = "fold long, train_rows double, test_rows double, mse double, mae double, rmse double, mape double"


def native_backtest(df: DataFrame, time_col: str, target_col: str, folds: Folds, kind: str = "last", tie_breakers: Sequence[str] = ()) -> DataFrame:
    """(fold, train_rows, test_rows, mse, mae, rmse, mape) of the last value or the mean as the forecast.

    Forecasts come from running aggregates at each fold's last training row, so training rows aren't repeated for every fold; test rows are.
    """
    require(df, time_col, target_col)
    from .spec import SeriesSpec

    rows = SeriesSpec(time_col, (), tie_breakers).indexed(df.select(*dict.fromkeys([time_col, *tie_breakers, target_col])), "_i")
    n = folds.count(df.count())
    i = F.col("_i")
    tests = rows.select("_i", F.col(target_col).alias("_a"), F.explode(folds.test_of(i, n)).alias("fold")) if n else rows.select("_i", F.col(target_col).alias("_a"), F.lit(0).cast("long").alias("fold")).limit(0)
    ends = df.sparkSession.range(n).select(F.col("id").alias("fold"), (F.col("id") * folds.step + folds.min_train - 1).alias("_i"))
    if kind == "last":
        forecast = rows.join(ends, "_i").select("fold", F.col(target_col).alias("_p"))
    else:
        # the sum up to a row is the sum of the runs before it and of its own run's rows
        size = 100_000
        runs = rows.withColumn("_run", F.floor(i / size))
        totals = runs.groupBy("_run").agg(F.sum(target_col).alias("_t"), F.count(target_col).alias("_c"))
        earlier = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select("_run", F.coalesce(F.sum("_t").over(earlier), F.lit(0.0)).alias("_bt"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_bc"))
        inner = Window.partitionBy("_run").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
        runs = runs.join(totals, "_run").select("_i", (F.col("_bt") + F.coalesce(F.sum(target_col).over(inner), F.lit(0.0))).alias("_s"), (F.col("_bc") + F.count(target_col).over(inner)).alias("_n"))
        forecast = runs.join(ends, "_i").select("fold", "_s", "_n")
        if folds.rolling:
            starts = runs.select((F.col("_i") + folds.min_train).alias("_i"), F.col("_s").alias("_s0"), F.col("_n").alias("_n0")).join(ends, "_i").select("fold", "_s0", "_n0")
            forecast = forecast.join(starts, "fold", "left").select("fold", (F.col("_s") - F.coalesce("_s0", F.lit(0.0))).alias("_s"), (F.col("_n") - F.coalesce("_n0", F.lit(0))).alias("_n"))
        forecast = forecast.select("fold", F.try_divide("_s", "_n").alias("_p"))
    train = F.lit(float(folds.min_train)) if folds.rolling else (F.col("fold") * folds.step + folds.min_train).cast("double")
    found = tests.join(forecast, "fold").groupBy("fold").agg(F.count(F.lit(1)).cast("double").alias("test_rows"), *error_aggregates("_a", "_p"))
    return found.select("fold", train.alias("train_rows"), "test_rows", "mse", "mae", "rmse", "mape")


class BacktestRunner:
    """A model over folds; each fold is a group of its own and gets its own copy of the model."""

    def __init__(self, test_size: int = 30, step_size: int = 1, n_splits: int | None = 5):
        Folds(1, test_size, step_size, n_splits)
        self.test_size, self.step_size, self.n_splits = test_size, step_size, n_splits

    def folds(self, min_train: int, rolling: bool = False) -> Folds:
        return Folds(min_train, self.test_size, self.step_size, self.n_splits, rolling)

    def run_expanding_window(self, model, df: DataFrame, time_col: str, target_col: str, min_train: int, *, details: bool = False) -> DataFrame:
        return self._run(model, df, time_col, target_col, self.folds(min_train), details)

    def run_rolling_window(self, model, df: DataFrame, time_col: str, target_col: str, window: int, *, details: bool = False) -> DataFrame:
        return self._run(model, df, time_col, target_col, self.folds(window, rolling=True), details)

    def _run(self, model, df, time_col, target_col, folds: Folds, details: bool) -> DataFrame:
        """One row a fold; with details also the arrays predictions, actuals and residuals."""
        require(df, time_col, target_col)
        rows = folds.assign(df.select(time_col, F.col(target_col).cast("double").alias("_y")), time_col).select("fold", "_i", "is_test", "_y")

        def run(key, pdf):
            import pandas as pd

            pdf = pdf.sort_values("_i")
            train, test = pdf[~pdf["is_test"]]["_y"].tolist(), pdf[pdf["is_test"]]["_y"].tolist()
            own = copy.deepcopy(model)
            if hasattr(own, "fit"):
                own.fit(train)
            found = [float(x) for x in own.predict(train, len(test))]
            m = list_metrics(found, test)
            row = [int(key[0]), float(len(train)), float(len(test)), m["mse"], m["mae"], m["rmse"], m["mape"]]
            names = ["fold", "train_rows", "test_rows", "mse", "mae", "rmse", "mape"]
            if details:
                row += [found, test, [a - p for a, p in zip(test, found, strict=True)]]
                names += ["predictions", "actuals", "residuals"]
            return pd.DataFrame([row], columns=names)

        schema = METRICS + ", predictions array<double>, actuals array<double>, residuals array<double>" * details
        return rows.groupBy("fold").applyInPandas(run, schema)

    def __repr__(self) -> str:
        return f"BacktestRunner(test_size={self.test_size}, step_size={self.step_size}, n_splits={self.n_splits})"
