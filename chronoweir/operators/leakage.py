"""Fingerprints of series and checks whether a test series overlaps a training one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spec import SeriesSpec, micros, require

EXACT, SAME_VALUES, OVERLAP = 1.0, 0.95, 0.5
FINGERPRINT = "name string, n_rows long, time_min long, time_max long, time_hash decimal(38,0), value_hash decimal(38,0)"


def hashable(df: DataFrame, column: str) -> None:
    """Raises for types without a fixed width."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DecimalType) or not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)):
        raise TypeError(f"Column '{column}' of type {kind.simpleString()} can't be fingerprinted")


def series_hash(position: Column, column: Column) -> Column:
    """A hash of the values in their order, as an aggregate: positions are hashed along, so partitions don't matter."""
    a, b = F.bit_xor(F.xxhash64(position, column)), F.bit_xor(F.xxhash64(F.lit(29), position, column))
    # both 64-bit halves as one number would overflow a decimal; half of the second's bits are kept
    return (a.cast("decimal(38,0)") * F.lit(1 << 32) + F.shiftrightunsigned(b, 32)).cast("decimal(38,0)")


def fingerprint(df: DataFrame, time_col: str, value_col: str, name: str, tie_breakers: Sequence[str] = ()) -> DataFrame:
    """One row: name, number of rows, bounds of time, and hashes of times and values in the order of time."""
    require(df, time_col, value_col)
    hashable(df, value_col)
    rows = SeriesSpec(time_col, (), tie_breakers).indexed(df, "_i").select("_i", micros(df, time_col).alias("_t"), F.col(value_col).alias("_v"))
    i, t, v = F.col("_i"), F.col("_t"), F.col("_v")
    hashes = (F.coalesce(series_hash(i, x), F.lit(0).cast("decimal(38,0)")) for x in (t, v))
    found = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.min("_t").alias("time_min"), F.max("_t").alias("time_max"), *(h.alias(n) for h, n in zip(hashes, ("time_hash", "value_hash"), strict=True)))
    return found.select(F.lit(name).alias("name"), "*")


def grouped_fingerprints(df: DataFrame, spec: SeriesSpec, value_col: str) -> DataFrame:
    """A fingerprint for each series of a partitioned spec."""
    rows = spec.indexed(df, "_i").withColumns({"_t": micros(df, spec.time_col)})
    return rows.groupBy(*spec.partition_cols).agg(F.count(F.lit(1)).alias("n_rows"), F.min("_t").alias("time_min"), F.max("_t").alias("time_max"), series_hash(F.col("_i"), F.col("_t")).alias("time_hash"), series_hash(F.col("_i"), F.col(value_col)).alias("value_hash"))


def similarity(a: str, b: str) -> Column:
    """The score of two fingerprints, given as struct columns: 1 for equal series, 0 without common time, 0.95 for equal values, else 0.5."""
    x, y = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    same = x("value_hash") == y("value_hash")
    apart = (x("time_max") < y("time_min")) | (y("time_max") < x("time_min"))
    whole = same & (x("time_hash") == y("time_hash")) & (x("n_rows") == y("n_rows"))
    return F.when(whole, EXACT).when(apart | x("time_min").isNull() | y("time_min").isNull(), 0.0).when(same, SAME_VALUES).otherwise(OVERLAP)


def scores(train: DataFrame, test: DataFrame) -> DataFrame:
    """(test_name, train_name, similarity) for two tables of fingerprints, one row a series."""
    a, b = train.select(F.struct("*").alias("a")), test.select(F.struct("*").alias("b"))
    return a.crossJoin(b).select(F.col("b.name").alias("test_name"), F.col("a.name").alias("train_name"), similarity("a", "b").alias("similarity"))


def pair_overlap(train: DataFrame, test: DataFrame, time_col: str, value_col: str) -> DataFrame:
    """One row: the test's rows, those whose (time, value) the training rows have, and their share."""
    known = train.select(time_col, value_col).distinct().withColumn("_known", F.lit(1))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"k.{c}")) for c in (time_col, value_col)]
    found = test.alias("t").join(known.alias("k"), same[0] & same[1], "left")
    n, hit = F.count(F.lit(1)), F.count("_known")
    return found.agg(n.alias("n_test"), hit.alias("n_matching"), F.coalesce(F.try_divide(hit, n), F.lit(0.0)).alias("share"))


def window_overlap(train: DataFrame, test: DataFrame, spec: SeriesSpec, value_col: str, size: int) -> DataFrame:
    """The test's windows of `size` rows whose values some window of the training rows has: (start), the position where one begins."""

    def windows(df):
        from .contexts import contexts

        return contexts(df, spec, value_col, size).select("start", F.xxhash64("context").alias("_a"), F.xxhash64(F.lit(29), "context").alias("_b"))

    return windows(test).join(windows(train).select("_a", "_b").distinct(), ["_a", "_b"], "left_semi").select("start")


class LeakageDetector:
    """Registered training series, and checks of test series against them. Fingerprints are one row each; series keep their frames, unread until a check."""

    def __init__(self, threshold: float = 0.1):
        self.threshold = threshold
        self._prints: DataFrame | None = None
        self._series: dict[str, tuple[DataFrame, str, str]] = {}
        self._report: dict[str, list[tuple[str, float]]] = {}

    def register_training_frame(self, df: DataFrame, time_col: str, value_col: str, name: str) -> dict:
        row = fingerprint(df, time_col, value_col, name).first()
        mine = df.sparkSession.createDataFrame([tuple(row)], FINGERPRINT)
        self._prints = mine if self._prints is None else self._prints.unionByName(mine)
        return row.asDict()

    def score_frame(self, df: DataFrame, time_col: str, value_col: str, name: str) -> DataFrame:
        if self._prints is None:
            raise ValueError("no training frame is registered")
        return scores(self._prints, fingerprint(df, time_col, value_col, name))

    def check_test_frame(self, df: DataFrame, time_col: str, value_col: str, name: str) -> dict:
        """Raises if a training frame is more similar than the threshold; else an empty dict."""
        if self._prints is None:
            return {}
        found = [(r["train_name"], r["similarity"]) for r in self.score_frame(df, time_col, value_col, name).filter(F.col("similarity") > self.threshold).collect()]
        return self._judge(name, found)

    def register_training_feature(self, df: DataFrame, time_col: str, value_col: str, name: str) -> None:
        self.register_training_frame(df, time_col, value_col, name)
        self._series[name] = df, time_col, value_col

    def check_test_feature(self, df: DataFrame, time_col: str, value_col: str, name: str) -> dict:
        """Raises for a series equal to a training one, or sharing more than the threshold of its (time, value) rows."""
        found = []
        for known, (train, t, v) in self._series.items():
            if any(r["similarity"] == EXACT for r in self.score_frame(df, time_col, value_col, name).filter(F.col("train_name") == known).collect()):
                raise ValueError(f"EXACT MATCH: '{name}' equals training feature '{known}'")
            renamed = train.select(F.col(t).alias(time_col), F.col(v).alias(value_col))
            share = pair_overlap(renamed, df, time_col, value_col).first()["share"]
            if share > self.threshold:
                found.append((known, share))
        return self._judge(name, found)

    def _judge(self, name: str, found: list[tuple[str, float]]) -> dict:
        if found:
            self._report[name] = found
            raise ValueError(f"LEAKAGE DETECTED in '{name}': {found}")
        return {}

    def get_report(self) -> dict[str, list[tuple[str, float]]]:
        return dict(self._report)
