"""Frames from lists, Arrow tables and files, and back."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from ..operators.features import FeatureWindow, normalize_lags, rolling_mean
from ..operators.spec import SeriesSpec

FORMATS = ("parquet", "orc", "csv", "json")


def from_list(spark: SparkSession, values: Sequence[float | None]) -> DataFrame:
    """(seq, value) in the order of the list."""
    rows = [(i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "seq long, value double")


def to_list(df: DataFrame, column: str, order: str = "seq") -> list:
    return [r[column] for r in df.orderBy(order).collect()]


def from_arrow(spark: SparkSession, table: pa.Table, seq: str | None = "seq") -> DataFrame:
    """An Arrow table with its rows numbered; times without a zone keep their type."""
    if not isinstance(table, pa.Table):
        raise TypeError(f"expected an Arrow table, got {type(table).__name__}")
    if seq is not None:
        table = table.append_column(seq, pa.array(range(table.num_rows), pa.int64()))
    return spark.createDataFrame(table, from_arrow_schema(table.schema, prefer_timestamp_ntz=True))


def read(spark: SparkSession, uri: str, fmt: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format '{fmt}'")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(uri)


def write_series(df: DataFrame, uri: str, spec: SeriesSpec, partitions: int | None = None, mode: str = "errorifexists") -> None:
    """Parquet clustered by time, so that cutoffs skip row groups."""
    keys = [F.col(c) for c in (spec.time_col, *spec.partition_cols)]
    rows = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    rows.sortWithinPartitions(*keys).write.mode(mode).parquet(uri)


class ListWindow:
    """Lags and rolling means of plain lists, computed by Spark."""

    def __init__(self, spark: SparkSession, lags: Sequence[int], rolling: Sequence[int] | None = None):
        self.spark, self.lags, self.rolling = spark, normalize_lags(lags), list(rolling or [])
        self.spec = SeriesSpec("seq")

    def transform(self, values: Sequence[float], include_rolling: bool = False) -> list[list[float | None]]:
        made = FeatureWindow(self.spec, self.lags, self.rolling if include_rolling else None)
        rows = made.transform(from_list(self.spark, values), "value").orderBy("seq").collect()
        return [[r[n] for r in rows] for n in made.expressions("value")]

    def rolling_mean(self, values: Sequence[float], window: int) -> list[float | None]:
        return to_list(from_list(self.spark, values).withColumn("m", rolling_mean(self.spec, "value", window)), "m")

    def __repr__(self) -> str:
        return f"ListWindow(lags={self.lags}, rolling={self.rolling})"
