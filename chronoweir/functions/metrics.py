"""Forecast errors, as aggregates and for lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def error_aggregates(actual: str | Column, predicted: str | Column) -> list[Column]:
    """mse, mae, rmse and mape: the last sums over actuals other than 0, divided by the number of all rows, times 100."""
    a, p = (F.col(c) if isinstance(c, str) else c for c in (actual, predicted))
    e = a - p
    mse = F.avg(e * e)
    share = F.coalesce(F.sum(F.when(a != 0, F.abs(e / F.when(a != 0, a)))), F.lit(0.0)) / F.count(F.lit(1)) * 100
    return [mse.alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(mse).alias("rmse"), share.alias("mape")]


def list_metrics(predictions: Sequence[float], actuals: Sequence[float]) -> dict[str, float]:
    """The same for two lists of one length."""
    if len(predictions) != len(actuals):
        raise ValueError(f"Prediction length {len(predictions)} differs from actual length {len(actuals)}")
    if not len(actuals):
        raise ValueError("metrics of empty lists")
    pairs = [(float(a), float(p)) for a, p in zip(actuals, predictions, strict=True)]
    n = len(pairs)
    mse = sum((a - p) ** 2 for a, p in pairs) / n
    return {"mse": mse, "mae": sum(abs(a - p) for a, p in pairs) / n, "rmse": mse**0.5, "mape": sum(abs((a - p) / a) for a, p in pairs if a) / n * 100}
