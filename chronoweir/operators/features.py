"""Lags, rolling, exponential, weighted and expanding means as window columns.

All look backwards only. A frame that is one series is cut into runs of rows, each with the last rows of the run before it (a halo), so that look-back never needs all rows in one task: FeatureWindow.transform(), add_duration_mean() and add_expanding() do so. The functions that give columns are for series with keys; without keys their window is one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durations import duration_micros
from .spec import Bins, SeriesSpec, below, micros, require

#: Look-back beyond which an exponential mean is made by a pass in pandas.
MAX_EMA_ROWS = 2_000
#: Rows of a run of one long series.
RUN_ROWS = 20_000


def normalize_lags(lags: Sequence[int] | None) -> list[int]:
    """Lags as a list of whole numbers. A negative lag would read the future."""
    out = [int(k) for k in lags or []]
    if any(k < 0 for k in out):
        raise ValueError("Lags must be non-negative")
    return out


def _positive(window: int) -> int:
    if window <= 0:
        raise ValueError("window must be positive")
    return window


def lag(spec: SeriesSpec, column: str, k: int) -> Column:
    """The value k rows earlier; null before the series begins."""
    (k,) = normalize_lags([k])
    return F.col(column) if k == 0 else F.lag(column, k).over(spec.window())


def rolling_mean(spec: SeriesSpec, column: str, window: int) -> Column:
    """The mean of the last `window` values; null unless all of them are there."""
    w = spec.window().rowsBetween(1 - _positive(window), 0)
    return F.when(F.count(column).over(w) == window, F.avg(column).over(w))


def rolling_mean_duration(df: DataFrame, spec: SeriesSpec, column: str, duration: str | int) -> Column:
    """The mean over the time (t - duration, t]; a number is in the unit of an integer time column."""
    span = duration_micros(duration) if isinstance(duration, str) else _positive(duration)
    w = Window.partitionBy(*spec.partition_cols).orderBy(micros(df, spec.time_col)).rangeBetween(1 - span, 0)
    return F.avg(column).over(w)


def cumulative_sum(spec: SeriesSpec, column: str) -> Column:
    return F.sum(column).over(spec.window().rowsBetween(Window.unboundedPreceding, 0))


def expanding_mean(spec: SeriesSpec, column: str, total_length: bool = False) -> Column:
    """The mean of all values so far; with total_length, their sum over the length of the whole series."""
    if total_length:
        return cumulative_sum(spec, column) / F.count(F.lit(1)).over(Window.partitionBy(*spec.partition_cols))
    return F.avg(column).over(spec.window().rowsBetween(Window.unboundedPreceding, 0))


def _alpha(alpha: float) -> float:
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in the interval (0, 1]")
    return alpha


def ema_rows(alpha: float) -> int:
    """Rows after which a value's weight is below 1e-17."""
    return 0 if _alpha(alpha) == 1 else math.ceil(math.log(1e-17) / math.log1p(-alpha))


def ema(spec: SeriesSpec, column: str, alpha: float = 0.3, ignore_nulls: bool = False) -> Column:
    """The exponential mean y = alpha x + (1 - alpha) y before, from the first value on; null where the value is null. Unless nulls are ignored, weights fade over them too."""
    k = ema_rows(alpha)
    if k == 0:
        return F.col(column).cast("double")
    if k > MAX_EMA_ROWS:
        raise ValueError(f"alpha {alpha:g} looks back {k} rows; use ema_pass()")
    w = spec.window().rowsBetween(-k, 0)
    values = F.collect_list(F.struct(F.col(column).cast("double").alias("x"))).over(w)
    keep, none = F.lit(1 - alpha), F.lit(None).cast("double")

    def step(s: Column, e: Column) -> Column:
        fade = s["w"] if ignore_nulls else s["w"] * keep
        old = s["w"] * keep
        mean = F.when(s["y"].isNull(), e["x"]).otherwise((old * s["y"] + alpha * e["x"]) / (old + alpha))
        return F.struct(F.when(e["x"].isNull(), s["y"]).otherwise(mean).alias("y"), F.when(e["x"].isNull(), fade).otherwise(F.lit(1.0)).alias("w"))

    folded = F.aggregate(values, F.struct(none.alias("y"), F.lit(1.0).alias("w")), step, lambda s: s["y"])
    return F.when(F.col(column).isNotNull(), folded)


def ema_pass(df: DataFrame, spec: SeriesSpec, column: str, alpha: float, ignore_nulls: bool = False) -> DataFrame:
    """The same for small alpha: one pass over each series in a Python worker, which holds that series."""
    name, order = ema_name(column, alpha), spec.order
    _alpha(alpha)

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        pdf[name] = pdf[column].astype(float).ewm(alpha=alpha, adjust=False, ignore_na=ignore_nulls).mean().where(pdf[column].notna())
        return pdf

    schema = df.withColumn(name, F.lit(None).cast("double")).schema
    return df.groupBy(*spec.partition_cols).applyInPandas(run, schema)


def wma(spec: SeriesSpec, column: str, window: int) -> Column:
    """The mean with weights 1 to `window`, the newest heaviest; null unless all values are there."""
    total = _positive(window) * (window + 1) / 2
    return sum(((window - k) * lag(spec, column, k) for k in range(1, window)), window * F.col(column)) / F.lit(total)


def lag_name(column: str, k: int) -> str:
    return f"{column}_lag_{k}"


def rolling_name(column: str, window: int) -> str:
    return f"{column}_rolling_{window}"


def ema_name(column: str, alpha: float) -> str:
    return f"{column}_ema_{alpha:g}"


def append(df: DataFrame, columns: dict[str, Column], include_original: bool = True) -> DataFrame:
    """df with further columns, or those alone; a name that is there already is an error."""
    if taken := [n for n in columns if include_original and n in df.columns]:
        raise ValueError(f"Columns already present: {taken}")
    return df.select(*(["*"] if include_original else []), *(c.alias(n) for n, c in columns.items()))


def row_slice(df: DataFrame, spec: SeriesSpec, offset: int, length: int | None = None) -> DataFrame:
    """Rows offset to offset + length of each series."""
    if offset < 0 or (length is not None and length < 0):
        raise ValueError("offset and length must be non-negative")
    rows = spec.indexed(df, "_i").filter(F.col("_i") >= offset)
    return (rows if length is None else rows.filter(F.col("_i") < offset + length)).drop("_i")


class FeatureWindow:
    """Lags, rolling means and exponential means of some columns in one select."""

    def __init__(self, spec: SeriesSpec, lags: Sequence[int] | None = None, rolling: Sequence[int] | None = None, alphas: Sequence[float] | None = None):
        self.spec, self.lags = spec, normalize_lags(lags)
        self.rolling = [_positive(w) for w in rolling or []]
        self.alphas = [_alpha(a) for a in alphas or []]

    def look_back(self) -> int:
        return max([0, *self.lags, *(w - 1 for w in self.rolling), *(ema_rows(a) for a in self.alphas)])

    def expressions(self, column: str, spec: SeriesSpec | None = None) -> dict[str, Column]:
        spec = spec or self.spec
        out = {lag_name(column, k): lag(spec, column, k) for k in self.lags}
        out |= {rolling_name(column, w): rolling_mean(spec, column, w) for w in self.rolling}
        return out | {ema_name(column, a): ema(spec, column, a) for a in self.alphas}

    def create_lags(self, df: DataFrame, column: str, lags: Sequence[int] | None = None, *, include_original: bool = True) -> DataFrame:
        return FeatureWindow(self.spec, self.lags if lags is None else lags).transform(df, column, include_original=include_original)

    def rolling_mean(self, df: DataFrame, column: str, window: int, *, include_original: bool = True) -> DataFrame:
        return FeatureWindow(self.spec, rolling=[window]).transform(df, column, include_original=include_original)

    def ema(self, df: DataFrame, column: str, alpha: float = 0.3, *, include_original: bool = True) -> DataFrame:
        return FeatureWindow(self.spec, alphas=[alpha]).transform(df, column, include_original=include_original)

    def transform(self, df: DataFrame, columns: str | Sequence[str], *, include_original: bool = True, as_of: datetime | int | None = None, run_rows: int = RUN_ROWS) -> DataFrame:
        """df with all features, lazily. as_of drops later rows first, which no feature can see anyway, so the scan skips them. A frame that is one series is cut into runs of run_rows rows (0: not cut)."""
        columns = [columns] if isinstance(columns, str) else list(columns)
        self.spec.check(df, *columns)
        if as_of is not None:
            df = df.filter(F.col(self.spec.time_col) <= F.lit(as_of))
        if not self.spec.partition_cols and run_rows:
            return self._in_runs(df, columns, include_original, run_rows)
        return append(df, {n: e for c in columns for n, e in self.expressions(c).items()}, include_original)

    def _in_runs(self, df: DataFrame, columns: list[str], include_original: bool, run_rows: int) -> DataFrame:
        rows = Bins(df, self.spec).runs(df, run_rows, self.look_back())
        spec = SeriesSpec(self.spec.time_col, ["_run"], self.spec.tie_breakers)
        made = {n: e for c in columns for n, e in self.expressions(c, spec).items()}
        rows = append(rows, made).filter("_own")
        return rows.select(*(F.col(f"`{n}`") for n in ([*df.columns, *made] if include_original else made)))


def add_duration_mean(df: DataFrame, spec: SeriesSpec, column: str, duration: str | int, name: str = "rolling_mean", run_rows: int = RUN_ROWS) -> DataFrame:
    """df with rolling_mean_duration(), each row added up twice however many a window has.

    Times fall into blocks as long as the duration, so a window is the end of one block and the beginning of the next: a running sum of a block from its start, and one of the block before from its end. Sums are only added to, never subtracted from. A task has one block and the values of the block before; blocks replace runs, so run_rows changes nothing.
    """
    spec.check(df, column)
    if name in df.columns:
        raise ValueError(f"Columns already present: {[name]}")
    span = duration_micros(duration) if isinstance(duration, str) else _positive(duration)
    kind = df.select(F.avg(column).alias("m")).schema["m"].dataType
    value = F.col(column).cast("double") if kind.typeName() == "double" else F.col(column)
    keys = [f"_key{i}" for i in range(len(spec.partition_cols))]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), *(F.col(c).alias(k) for c, k in zip(spec.partition_cols, keys, strict=True)), micros(df, spec.time_col).alias("_t"), value.alias("_v"))
    # rows without a time are peers of each other only
    rows = rows.select("*", F.pmod("_t", F.lit(span)).alias("_at"), F.explode(F.when(F.col("_t").isNull(), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))).alias("_own"))
    own = F.col("_own")
    start = F.col("_t") - F.col("_at") + F.when(own, F.lit(0)).otherwise(F.lit(span))
    # a row of the block before counts for times less than a duration after it, so it stands before an own row of the same place
    rows = rows.select(*keys, "_own", "_v", F.when(own, F.col("_row")).alias("_row"), start.alias("_start"), (F.col("_at") * 2 + own.cast("long")).alias("_place"))
    block = Window.partitionBy(*keys, "_start")
    over = lambda order: block.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sides = ((F.when(own, F.col("_v")), over(F.asc("_place"))), (F.when(~own, F.col("_v")), over(F.desc("_place"))))
    made = rows.withColumns({f"_{n}{i}": of(v).over(w) for i, (v, w) in enumerate(sides) for n, of in (("s", F.sum), ("c", F.count))})
    total = F.coalesce(F.col("_s0") + F.col("_s1"), F.col("_s0"), F.col("_s1"))
    return made.filter("_own").select("_row.*", F.try_divide(total, F.col("_c0") + F.col("_c1")).cast(kind).alias(name))


def add_expanding(df: DataFrame, spec: SeriesSpec, column: str, total_length: bool = False) -> DataFrame:
    """df with {column}_cumulative and {column}_expanding_mean. In a frame that is one series, sums start from those of the bins before."""
    spec.check(df, column)
    names = f"{column}_cumulative", f"{column}_expanding_mean"
    if spec.partition_cols:
        return append(df, dict(zip(names, (cumulative_sum(spec, column), expanding_mean(spec, column, total_length)), strict=True)))
    bins = Bins(df, spec)
    # one row a bin
    found = df.select(bins.bin.alias("_bin"), F.col(column).alias("_v")).groupBy("_bin").agg(F.sum("_v").alias("s"), F.count("_v").alias("c")).orderBy("_bin").collect()
    sums, counts = (list(accumulate((r[k] or 0 for r in found), initial=0))[:-1] for k in ("s", "c"))
    w = Window.partitionBy("_bin").orderBy(*spec.order).rowsBetween(Window.unboundedPreceding, 0)
    own, seen = F.sum(column).over(w), F.count(column).over(w)
    kind = df.select(F.sum(column).alias("s")).schema["s"].dataType
    before = bins.of([float(x) for x in sums]) if kind.typeName() == "double" else F.get(F.array(*(F.lit(x).cast(kind) for x in sums or [0])), below(bins.ids, F.col("_bin")))
    count = bins.of(counts) + seen
    total = F.when(count > 0, before + F.coalesce(own, F.lit(0).cast(kind)))
    rows = bins.numbered(df).withColumns({names[0]: total, names[1]: F.try_divide(total, F.lit(bins.n) if total_length else count)})
    return rows.drop("_bin")


def feature_window(spec: SeriesSpec, lags: Sequence[int], rolling: Sequence[int] | None = None) -> FeatureWindow:
    return FeatureWindow(spec, lags, rolling)


def generate_lag(df: DataFrame, spec: SeriesSpec, column: str, k: int) -> DataFrame:
    """The lagged column under its own name; a lag longer than the frame is an error."""
    require(df, column)
    (k,) = normalize_lags([k])
    if k > (n := df.count()):
        raise ValueError(f"Lag {k} cannot exceed the length {n}")
    return df.select(*[c for c in spec.keys if c != column], lag(spec, column, k).alias(column))
