"""Forecasting models, batches of series, and ensembles."""

from __future__ import annotations

import copy
import importlib
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spec import SeriesSpec

FORECAST = "point array<double>, lower array<double>, upper array<double>, confidence double"
LEVEL = 0.95


class Model(Protocol):
    """predict gives `horizon` values, or a dict of point, lower and upper; fit(train) is optional. Models are pickled to the workers, and state doesn't go from one series or fold to another."""

    def predict(self, train: Sequence[float], horizon: int): ...


class HorizonOnly:
    """A model whose predict takes the horizon alone, after fit."""

    def __init__(self, model):
        self.model = model

    def fit(self, train):
        self.model.fit(train)

    def predict(self, train, horizon):
        return self.model.predict(horizon)


class LastValue:
    def predict(self, train, horizon):
        return [float(train[-1])] * horizon


class MeanValue:
    def predict(self, train, horizon):
        return [float(sum(train)) / len(train)] * horizon


@dataclass
class SeasonalNaive:
    period: int

    def predict(self, train, horizon):
        season = list(train)[-self.period :]
        return [float(season[i % len(season)]) for i in range(horizon)]


@dataclass
class Forecast:
    point: list[float]
    lower: list[float] = field(default_factory=list)
    upper: list[float] = field(default_factory=list)
    confidence: float = LEVEL

    @staticmethod
    def of(result) -> Forecast:
        if isinstance(result, dict):
            point = [float(x) for x in result.get("point", result.get("mean"))]
            return Forecast(point, *([float(x) for x in result.get(k, point)] for k in ("lower", "upper")))
        point = [float(x) for x in result]
        return Forecast(point, point, point)


class BatchPredictor:
    """One forecast a series; series are the unit of parallel work."""

    def __init__(self, spec: SeriesSpec, column: str, max_parallel: int | None = None):
        self.spec, self.column, self.max_parallel = spec, column, max_parallel

    def predict_batch(self, model: Model, df: DataFrame, horizon: int) -> DataFrame:
        """(series keys, point, lower, upper, confidence)."""
        self.spec.check(df, self.column)
        keys, order, column = list(self.spec.partition_cols), self.spec.order, self.column
        kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

        def run(key, pdf):
            import pandas as pd

            train = pdf.sort_values(order, kind="stable")[column].tolist()
            own = copy.deepcopy(model)  # what a series has taught a model is nothing to the next one
            if hasattr(own, "fit"):
                own.fit(train)
            f = Forecast.of(own.predict(train, horizon))
            return pd.DataFrame([(*key, f.point, f.lower, f.upper, f.confidence)], columns=[*keys, "point", "lower", "upper", "confidence"])

        rows = df.select(*self.spec.keys, column)
        if self.max_parallel and keys:
            rows = rows.repartition(self.max_parallel, *keys)
        return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, {FORECAST}" if keys else FORECAST)

    def predict_stream(self, model: Model, contexts: DataFrame, horizon: int, chunk_size: int) -> DataFrame:
        """Forecasts of rows with a context array, the model getting up to chunk_size contexts at once if it has predict_many."""
        if chunk_size <= 0:
            raise ValueError("chunk_size must be positive")
        names = [c for c in contexts.columns if c != "context"]
        kinds = ", ".join(f"{k} {contexts.schema[k].dataType.simpleString()}" for k in names)

        def run(frames):
            for pdf in frames:
                for at in range(0, len(pdf), chunk_size):
                    part = pdf.iloc[at : at + chunk_size]
                    many = list(part["context"])
                    found = model.predict_many(many, horizon) if hasattr(model, "predict_many") else [model.predict(c, horizon) for c in many]
                    made = [Forecast.of(r) for r in found]
                    yield part[names].assign(point=[f.point for f in made], lower=[f.lower for f in made], upper=[f.upper for f in made], confidence=LEVEL)

        return contexts.mapInPandas(run, f"{kinds}, {FORECAST}" if kinds else FORECAST)


def forward_batches(contexts: DataFrame, forward, horizon: int, batch_size: int = 32) -> DataFrame:
    """Forecasts of rows with a context array by forward(batch, horizon), which gets up to batch_size contexts of one length as a float32 matrix and gives a row of `horizon` values for each. Workers hold one batch at a time, under the cap of their process."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    names = [c for c in contexts.columns if c != "context"]
    kinds = ", ".join(f"`{k}` {contexts.schema[k].dataType.simpleString()}" for k in names)

    def run(frames):
        import numpy as np

        from ..functions.tensors import MemoryGuard

        for pdf in frames:
            for _, rows in pdf.groupby(pdf["context"].map(len), sort=False):
                for at in range(0, len(rows), batch_size):
                    part = rows.iloc[at : at + batch_size]
                    block = np.asarray(part["context"].tolist(), np.float32)
                    with MemoryGuard.reserve(block.nbytes):
                        found = np.asarray(forward(block, horizon), float).reshape(len(part), horizon)
                    yield part[names].assign(point=list(found))

    return contexts.mapInPandas(run, ", ".join(filter(None, [kinds, "point array<double>"])))


class EnsemblePredictor:
    """A weighted sum of models' forecasts; weights are equal by default and aren't normalized. Bounds are 0.9 and 1.1 times the point, the lesser first."""

    def __init__(self, models: Sequence[str], weights: Sequence[float] | None = None):
        if weights is not None and len(weights) != len(models):
            raise ValueError("Weights must match number of models")
        self.models = list(models)
        self.weights = list(weights) if weights is not None else [1.0 / len(self.models)] * len(self.models)

    def combine(self, forecasts: DataFrame, keys: Sequence[str], model_col: str = "model", value_col: str = "yhat") -> DataFrame:
        """(keys, point, lower, upper, confidence) from rows (keys, model, value); a key without one of the models is an error."""
        weight = F.coalesce(*(F.when(F.col(model_col) == m, F.lit(float(w))) for m, w in zip(self.models, self.weights, strict=True)))
        rows = forecasts.withColumn("_w", weight).filter("_w is not null").groupBy(*keys).agg(F.sum(F.col("_w") * F.col(value_col)).alias("point"), F.count_distinct(model_col).alias("_n"))
        missing = F.raise_error(F.concat(F.lit("models with a forecast: "), F.col("_n").cast("string"), F.lit(f" of {len(self.models)}"))).cast("double")
        rows = rows.select(*keys, F.when(F.col("_n") == len(set(self.models)), F.col("point")).otherwise(missing).alias("point"))
        low, high = F.col("point") * 0.9, F.col("point") * 1.1
        return rows.select("*", F.least(low, high).alias("lower"), F.greatest(low, high).alias("upper"), F.lit(LEVEL).alias("confidence"))

    def predict(self, models: dict[str, Model], series: Sequence[float], horizon: int) -> Forecast:
        """For one series on the driver; a model that isn't given is a KeyError."""
        found = [(w, Forecast.of(models[m].predict(series, horizon)).point) for m, w in zip(self.models, self.weights, strict=True)]
        point = [sum(w * p[i] for w, p in found) for i in range(horizon)]
        return Forecast(point, [min(0.9 * x, 1.1 * x) for x in point], [max(0.9 * x, 1.1 * x) for x in point])

    def __repr__(self) -> str:
        return f"EnsemblePredictor(models={self.models}, weights={self.weights})"


class FoundationModel:
    """A pretrained model behind predict(context, horizon); its library is imported when the model is loaded. loader is `module:function`, called with the options."""

    def __init__(self, loader: str, context_length: int = 512, prediction_length: int = 64, **options):
        self.loader, self.options = loader, options
        self.context_length, self.prediction_length = context_length, prediction_length
        self._model = None

    def load_model(self):
        module, _, function = self.loader.partition(":")
        try:
            self._model = getattr(importlib.import_module(module), function)(**self.options)
        except ImportError as e:
            raise RuntimeError(f"{module} is not installed") from e
        return self

    def prepare_input(self, values: Sequence[float]) -> list[list[float]]:
        """All windows of context_length values of a list."""
        n = len(values) - self.context_length + 1
        if n <= 0:
            raise ValueError(f"Need at least {self.context_length} values, got {len(values)}")
        return [list(map(float, values[i : i + self.context_length])) for i in range(n)]

    def predict(self, context: Sequence[float], horizon: int | None = None):
        if self._model is None:
            self.load_model()
        return self._model.predict(list(context)[-self.context_length :], horizon or self.prediction_length)

    def __getstate__(self):
        return self.__dict__ | {"_model": None}

    def __repr__(self) -> str:
        return f"FoundationModel('{self.loader}', context_length={self.context_length}, prediction_length={self.prediction_length})"


def zero_shot_loader(kind: str, model: str | None = None, **options) -> FoundationModel:
    """The three pretrained families with their usual lengths: chronos (512, 64), lag-llama (32, 1), moirai (512, 128)."""
    lengths = {"chronos": (512, 64), "lag-llama": (32, 1), "moirai": (512, 128)}
    if kind not in lengths:
        raise ValueError(f"unknown model family '{kind}'")
    return FoundationModel(f"{kind.replace('-', '_')}:load", *lengths[kind], **({"model": model} if model else {}), **options)


def native_baseline(df: DataFrame, spec: SeriesSpec, column: str, kind: str = "last") -> DataFrame:
    """(series keys, yhat) without Python: the last value or the mean of each series."""
    spec.check(df, column)
    value = F.max_by(column, F.struct(*spec.order)) if kind == "last" else F.avg(column)
    return df.groupBy(*spec.partition_cols).agg(value.alias("yhat"))
