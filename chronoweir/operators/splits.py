"""Train and test splits by time, and backtest folds by position."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spec import SeriesSpec, micros, require

Moment = datetime | int


def datetime_after(value: datetime) -> datetime:
    """The next moment that a timestamp can hold."""
    return value + timedelta(microseconds=1)


def validate_bounds(train_end: Moment, test_start: Moment) -> None:
    if test_start <= train_end:
        raise ValueError("Test start must be after train end (temporal leakage detected!)")


def masks(time_col: str, train_end: Moment, test_start: Moment) -> tuple[Column, Column]:
    """is_train and is_test as columns."""
    validate_bounds(train_end, test_start)
    t = F.col(time_col)
    return (t <= F.lit(train_end)).alias("is_train"), (t >= F.lit(test_start)).alias("is_test")


def with_masks(df: DataFrame, time_col: str, train_end: Moment, test_start: Moment) -> DataFrame:
    require(df, time_col)
    return df.select("*", *masks(time_col, train_end, test_start))


def sortedness_violations(df: DataFrame, time_col: str, seq_col: str, strict: bool = False) -> DataFrame:
    """One row, n_violations: neighbours by seq_col whose times fall, or with strict don't rise. Runs of rows meet at their ends only."""
    require(df, time_col, seq_col)
    rows = SeriesSpec(seq_col).indexed(df.select(seq_col, micros(df, time_col).alias("_t")), "_i")
    size = 100_000
    run = F.floor(F.col("_i") / size)
    rows = rows.withColumn("_run", F.explode(F.when(F.col("_i") % size == size - 1, F.array(run, run + 1)).otherwise(F.array(run))))
    before = F.lag("_t").over(Window.partitionBy("_run").orderBy("_i"))
    rows = rows.withColumn("_before", before)
    bad = F.col("_before") >= F.col("_t") if strict else F.col("_before") > F.col("_t")
    return rows.agg(F.count_if(bad).alias("n_violations"))


def assert_sorted_by(df: DataFrame, time_col: str, seq_col: str, strict: bool = False) -> None:
    """Raises unless the rows by seq_col are in the order of time."""
    require(df, time_col)
    if df.isEmpty():
        raise ValueError("Cannot split an empty DataFrame")
    if sortedness_violations(df, time_col, seq_col, strict).first()[0]:
        raise ValueError(f"Column '{time_col}' must be sorted ascending")


def cutoff_counts(df: DataFrame, time_col: str, value: Moment) -> DataFrame:
    """One row: n_leq and n_lt, rows at or before a moment and before it."""
    require(df, time_col)
    t = F.col(time_col)
    return df.agg(F.count_if(t <= F.lit(value)).alias("n_leq"), F.count_if(t < F.lit(value)).alias("n_lt"))


def count_leq(df: DataFrame, time_col: str, value: Moment) -> int:
    return cutoff_counts(df, time_col, value).first()["n_leq"]


def count_lt(df: DataFrame, time_col: str, value: Moment) -> int:
    return cutoff_counts(df, time_col, value).first()["n_lt"]


def temporal_split(df: DataFrame, time_col: str, train_end: Moment, test_start: Moment | None = None, seq_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows up to train_end, and from test_start on (or after train_end); rows between are in neither. Filters only, which the scan takes over; with seq_col the order is checked first."""
    require(df, time_col)
    if test_start is not None:
        validate_bounds(train_end, test_start)
    if seq_col is not None:
        assert_sorted_by(df, time_col, seq_col)
    t = F.col(time_col)
    return df.filter(t <= F.lit(train_end)), df.filter(t > F.lit(train_end) if test_start is None else t >= F.lit(test_start))


def time_bounds(df: DataFrame, time_col: str) -> DataFrame:
    require(df, time_col)
    return df.agg(F.min(time_col).alias("time_min"), F.max(time_col).alias("time_max"), F.count(F.lit(1)).alias("n_rows"))


def validate_coverage(df: DataFrame, time_col: str, train_end: Moment, test_start: Moment, seq_col: str | None = None) -> bool:
    """True if both sides of the split have rows, else an error."""
    require(df, time_col)
    if seq_col is not None:
        assert_sorted_by(df, time_col, seq_col)
    validate_bounds(train_end, test_start)
    lo, hi, n = time_bounds(df, time_col).first()
    if not n:
        raise ValueError("Cannot split an empty DataFrame")
    if lo is None or lo > train_end or hi < test_start:
        raise ValueError("The data does not cover the requested split")
    return True


class TemporalValidator:
    """A split's bounds, and checks that a moment or a frame doesn't reach past the training side."""

    def __init__(self):
        self.train_end: Moment | None = None
        self.test_start: Moment | None = None

    def set_split(self, train_end: Moment, test_start: Moment) -> None:
        validate_bounds(train_end, test_start)
        self.train_end, self.test_start = train_end, test_start

    def check_feature_window(self, moment: Moment) -> bool:
        if self.train_end is not None and moment > self.train_end:
            raise ValueError(f"Feature at {moment} is after train end {self.train_end}: TEMPORAL LEAKAGE DETECTED.")
        return True

    def check_frame(self, df: DataFrame, time_col: str) -> bool:
        last = time_bounds(df, time_col).first()["time_max"]
        return last is None or self.check_feature_window(last)

    def validate_split(self, df: DataFrame, time_col: str, train_end: Moment, test_start: Moment) -> bool:
        return validate_coverage(df, time_col, train_end, test_start)

    def split(self, df: DataFrame, time_col: str, train_end: Moment, test_start: Moment | None = None) -> tuple[DataFrame, DataFrame]:
        return temporal_split(df, time_col, train_end, test_start)

    def __repr__(self) -> str:
        return f"TemporalValidator(train_end={self.train_end}, test_start={self.test_start})"


class TemporalSplitter:
    """Boolean lists for plain Python lists of moments."""

    def __init__(self):
        self.validator = TemporalValidator()

    def split(self, timestamps: Sequence[Moment], train_end: Moment, test_start: Moment) -> tuple[list[bool], list[bool]]:
        self.validator.set_split(train_end, test_start)
        return [t <= train_end for t in timestamps], [t >= test_start for t in timestamps]

    def validate_feature(self, moment: Moment) -> bool:
        return self.validator.check_feature_window(moment)


@dataclass(frozen=True)
class Folds:
    """Folds over n rows by position: fold f trains on rows before min_train + f * step (the last min_train of them if rolling) and tests on the next `test` rows, while those are all there.

    Rows find their folds by arithmetic, so folds cost neither a join nor a list; a row appears once for each fold that it is in.
    """

    min_train: int
    test: int
    step: int = 1
    n_splits: int | None = None
    rolling: bool = False

    def __post_init__(self):
        if self.min_train <= 0 or self.test <= 0 or self.step <= 0 or (self.n_splits is not None and self.n_splits <= 0):
            raise ValueError("fold sizes and steps must be positive")

    def count(self, n: int) -> int:
        found = max(0, (n - self.test - self.min_train) // self.step + 1) if n >= self.test + self.min_train else 0
        return found if self.n_splits is None else min(found, self.n_splits)

    def train_of(self, i: Column, folds: int) -> Column:
        """The folds, as an array, in which position i trains."""
        first = F.greatest(F.floor((i - self.min_train) / self.step) + 1, F.lit(0))
        last = F.least(F.floor(i / self.step), F.lit(folds - 1)) if self.rolling else F.lit(folds - 1)
        return F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def test_of(self, i: Column, folds: int) -> Column:
        first = F.greatest(F.ceil((i - self.min_train - self.test + 1) / self.step), F.lit(0))
        last = F.least(F.floor((i - self.min_train) / self.step), F.lit(folds - 1))
        return F.when((first <= last) & (i >= self.min_train), F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def assign(self, df: DataFrame, time_col: str, tie_breakers: Sequence[str] = ()) -> DataFrame:
        """df's rows with _i, fold and is_test, once for each fold that has them."""
        rows = SeriesSpec(time_col, (), tie_breakers).indexed(df, "_i")
        folds = self.count(df.count())
        if not folds:
            return rows.select("*", F.lit(0).cast("long").alias("fold"), F.lit(False).alias("is_test")).limit(0)
        i = F.col("_i")
        both = F.concat(F.transform(self.train_of(i, folds), lambda f: F.struct(f.alias("fold"), F.lit(False).alias("is_test"))), F.transform(self.test_of(i, folds), lambda f: F.struct(f.alias("fold"), F.lit(True).alias("is_test"))))
        return rows.withColumn("_f", F.explode(both)).select(*df.columns, "_i", "_f.fold", "_f.is_test")

    def statistics(self, df: DataFrame, time_col: str, tie_breakers: Sequence[str] = ()) -> DataFrame:
        """(fold, train_rows, test_rows, gap) by fold; the gap is from the last training time to the first test time.

        One pass: of all positions only those at both sides of a fold's cut are kept.
        """
        spec, at = SeriesSpec(time_col, (), tie_breakers), F.col("_i") - self.min_train
        rows = spec.indexed(df.select(*dict.fromkeys(spec.order)), "_i").select("_i", micros(df, time_col).alias("_t"))
        sides = F.array(F.struct(at.alias("d"), F.lit(True).alias("first")), F.struct((at + 1).alias("d"), F.lit(False).alias("first")))
        rows = rows.withColumn("_side", F.explode(sides)).filter((F.col("_side.d") >= 0) & (F.col("_side.d") % self.step == 0))
        fold = F.floor(F.col("_side.d") / self.step).alias("fold")
        found = rows.groupBy(fold).agg(F.max(F.when(~F.col("_side.first"), F.col("_t"))).alias("_last"), F.max(F.when(F.col("_side.first"), F.col("_t"))).alias("_first"))
        train = F.lit(self.min_train).cast("long") if self.rolling else F.col("fold") * self.step + self.min_train
        found = found.filter(F.col("fold") < self.count(df.count()))
        return found.select("fold", train.cast("long").alias("train_rows"), F.lit(self.test).cast("long").alias("test_rows"), (F.col("_first") - F.col("_last")).alias("gap"))

    def split(self, df: DataFrame, time_col: str, train_end: Moment, test_start: Moment | None = None) -> tuple[DataFrame, DataFrame]:
        return temporal_split(df, time_col, train_end, test_start)

    def __repr__(self) -> str:
        return f"TemporalValidator(train_end={self.train_end}, test_start={self.test_start})"


class TemporalSplitter:
    """Boolean lists for plain Python lists of moments."""

    def __init__(self):
        self.validator = TemporalValidator()

    def split(self, timestamps: Sequence[Moment], train_end: Moment, test_start: Moment) -> tuple[list[bool], list[bool]]:
        self.validator.set_split(train_end, test_start)
        return [t <= train_end for t in timestamps], [t >= test_start for t in timestamps]

    def validate_feature(self, moment: Moment) -> bool:
        return self.validator.check_feature_window(moment)


@dataclass(frozen=True)
class Folds:
    """Folds over n rows by position: fold f trains on rows before min_train + f * step (the last min_train of them if rolling) and tests on the next `test` rows, while those are all there.

    Rows find their folds by arithmetic, so folds cost neither a join nor a list; a row appears once for each fold that it is in.
    """

    min_train: int
    test: int
    step: int = 1
    n_splits: int | None = None
    rolling: bool = False

    def __post_init__(self):
        if self.min_train <= 0 or self.test <= 0 or self.step <= 0 or (self.n_splits is not None and self.n_splits <= 0):
            raise ValueError("fold sizes and steps must be positive")

    def count(self, n: int) -> int:
        found = max(0, (n - self.test - self.min_train) // self.step + 1) if n >= self.test + self.min_train else 0
        return found if self.n_splits is None else min(found, self.n_splits)

    def train_of(self, i: Column, folds: int) -> Column:
        """The folds, as an array, in which position i trains."""
        first = F.greatest(F.floor((i - self.min_train) / self.step) + 1, F.lit(0))
        last = F.least(F.floor(i / self.step), F.lit(folds - 1)) if self.rolling else F.lit(folds - 1)
        return F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def test_of(self, i: Column, folds: int) -> Column:
        first = F.greatest(F.ceil((i - self.min_train - self.test + 1) / self.step), F.lit(0))
        last = F.least(F.floor((i - self.min_train) / self.step), F.lit(folds - 1))
        return F.when((first <= last) & (i >= self.min_train), F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def assign(self, df: DataFrame, time_col: str, tie_breakers: Sequence[str] = ()) -> DataFrame:
        """df's rows with _i, fold and is_test, once for each fold that has them."""
        rows = SeriesSpec(time_col, (), tie_breakers).indexed(df, "_i")
        folds = self.count(df.count())
        if not folds:
            return rows.select("*", F.lit(0).cast("long").alias("fold"), F.lit(False).alias("is_test")).limit(0)
        i = F.col("_i")
        both = F.concat(F.transform(self.train_of(i, folds), lambda f: F.struct(f.alias("fold"), F.lit(False).alias("is_test"))), F.transform(self.test_of(i, folds), lambda f: F.struct(f.alias("fold"), F.lit(True).alias("is_test"))))
        return rows.withColumn("_f", F.explode(both)).select(*df.columns, "_i", "_f.fold", "_f.is_test")

    def statistics(self, df: DataFrame, time_col: str, tie_breakers: Sequence[str] = ()) -> DataFrame:
        """(fold, train_rows, test_rows, gap) by fold; the gap is from the last training time to the first test time.

        Positions where folds begin and end are looked up; training rows aren't repeated.
        """
        n = df.count()
        rows = SeriesSpec(time_col, (), tie_breakers).indexed(df.select(micros(df, time_col).alias("_t"), *{time_col, *tie_breakers}), "_i").select("_i", "_t")
        folds = df.sparkSession.range(self.count(n)).select(F.col("id").alias("fold"), (F.col("id") * self.step + self.min_train).alias("_at"))
        last, first = rows.select((F.col("_i") + 1).alias("_at"), F.col("_t").alias("_last")), rows.select(F.col("_i").alias("_at"), F.col("_t").alias("_first"))
        train = F.lit(self.min_train).cast("long") if self.rolling else F.col("_at")
        found = folds.join(last, "_at").join(first, "_at")
        return found.select("fold", train.alias("train_rows"), F.lit(self.test).cast("long").alias("test_rows"), (F.col("_first") - F.col("_last")).alias("gap"))

    def split(self, df: DataFrame, time_col: str, tie_breakers: Sequence[str] = ()) -> list[tuple[DataFrame, DataFrame]]:
        """A pair of lazy frames for each fold."""
        rows = SeriesSpec(time_col, (), tie_breakers).indexed(df, "_i")
        i, out = F.col("_i"), []
        for f in range(self.count(df.count())):
            at = self.min_train + f * self.step
            train = rows.filter(i < at) if not self.rolling else rows.filter((i < at) & (i >= at - self.min_train))
            out.append((train.drop("_i"), rows.filter((i >= at) & (i < at + self.test)).drop("_i")))
        return out
