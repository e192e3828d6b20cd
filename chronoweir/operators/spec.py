"""What orders a frame's rows into series, and positions in that order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.internal import InternalFunction

#: Bins that a series over a whole frame is cut into, at least and at most; between them 4 times the shuffle partitions. And bins by tie-breakers that a time with very many rows is cut into, and how many such times are.
BINS, MOST_BINS, SUB_BINS, HEAVY = 64, 4096, 256, 64


def require(df: DataFrame, *columns: str) -> None:
    """Raises if a column is missing; looks at the schema only."""
    if not isinstance(df, DataFrame):
        raise TypeError(f"expected a Spark DataFrame, got {type(df).__name__}")
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"Column '{c}' not found")


def micros(df: DataFrame, column: str) -> Column:
    """A time column as a long: microseconds for dates and timestamps, integers as they are. A timestamp without zone is counted from an epoch without zone, so that clock changes of the session's zone don't move it."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long") * 86_400_000_000
    if isinstance(kind, T.TimestampNTZType):
        since = F.col(column) - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
        days, hours, minutes, seconds = (F.extract(F.lit(u), since) for u in ("DAY", "HOUR", "MINUTE", "SECOND"))
        return ((days.cast("long") * 24 + hours) * 60 + minutes) * 60_000_000 + (seconds * 1_000_000).cast("long")
    if isinstance(kind, T.IntegralType):
        return F.col(column).cast("long")
    raise TypeError(f"Column '{column}' is neither a time nor an integer")


def literal(values: Sequence) -> Column:
    """Numbers, or lists of numbers, as an array; one expression, however many there are."""

    def text(v) -> str:
        return f"array({','.join(map(text, v))})" if isinstance(v, (list, tuple)) else f"{v!r}D" if isinstance(v, float) else f"{v}L"

    return F.expr(text(list(values)))


def below(cuts: Sequence[float], value: Column) -> Column:
    """How many of the ascending, distinct cuts are less than a value: one binary search in compiled code. The value stands in it once, since Spark puts searches whose value is a search into one expression."""
    if not cuts:
        return F.lit(0)
    if any(isinstance(c, float) for c in cuts):
        # the search tells -0.0 from 0.0
        cuts, value = [float(c) + 0.0 for c in cuts], value.cast("double")
    # the search has a place from 0 for a value among the cuts, else -1 - the place where it would be
    n = len(cuts)
    places = literal([*range(n, -1, -1), *range(n)])
    return F.get(places, InternalFunction.array_binary_search(literal(cuts), value) + n + 1)


@dataclass(frozen=True)
class SeriesSpec:
    """time_col and tie_breakers order the rows of each series; partition_cols tell series apart, and without them the frame is one series."""

    time_col: str
    partition_cols: Sequence[str] = ()
    tie_breakers: Sequence[str] = ()

    @property
    def order(self) -> list[str]:
        return [self.time_col, *self.tie_breakers]

    @property
    def keys(self) -> list[str]:
        return [*self.partition_cols, *self.order]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.partition_cols).orderBy(*self.order)

    def check(self, df: DataFrame, *columns: str) -> None:
        require(df, *self.keys, *columns)

    def indexed(self, df: DataFrame, name: str = "_i") -> DataFrame:
        """df with each row's position in its series, from 0.

        One series over the whole frame is cut into bins, which are counted and numbered each by itself, so no task sees all rows.
        """
        self.check(df)
        if self.partition_cols:
            return df.withColumn(name, F.row_number().over(self.window()).cast("long") - 1)
        bins = Bins(df, self)
        number = F.row_number().over(Window.partitionBy("_bin").orderBy(*self.order)) - 1
        return bins.numbered(df).withColumn(name, bins.of(bins.before) + number).drop("_bin")


class Bins:
    """A frame that is one series, cut into bins of neighbouring rows: at quantiles of time, and a time that holds many rows at quantiles of the first tie-breaker, if that is a number or a time.

    Two or three small jobs find the cuts and count the rows of each bin; at most MOST_BINS + HEAVY * SUB_BINS numbers come to the driver. A row's bin is a function of its own columns.
    """

    def __init__(self, df: DataFrame, spec: SeriesSpec):
        t = micros(df, spec.time_col)
        n = min(MOST_BINS, max(BINS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        shares = ", ".join(str(i / n) for i in range(1, n))
        found = df.select(t.alias("t")).agg(F.expr(f"percentile_approx(t, array({shares}), {20 * n})")).first()[0] or []
        often = Counter(found)
        heavy = sorted((c for c, k in often.items() if k > 1), key=lambda c: -often[c])[:HEAVY] if spec.tie_breakers else []
        kind = df.schema[spec.tie_breakers[0]].dataType if heavy else None
        if not isinstance(kind, (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            heavy = []
        self.cuts = sorted({*found, *(c - 1 for c in heavy)})
        self.bin = F.coalesce(below(self.cuts, t), F.lit(0)).cast("long") * SUB_BINS
        if heavy:
            tie = micros(df, spec.tie_breakers[0])
            shares = ", ".join(str(i / SUB_BINS) for i in range(1, SUB_BINS))
            ties = df.select(t.alias("t"), tie.alias("x")).filter(F.col("t").isin(heavy)).groupBy("t").agg(F.expr(f"percentile_approx(x, array({shares}), {20 * SUB_BINS})").alias("c")).collect()
            sub = F.lit(0)
            for r in ties:
                sub = F.when(t == r["t"], F.coalesce(below(sorted(set(r["c"] or [])), tie), F.lit(0))).otherwise(sub)
            self.bin = self.bin + sub
        counts = sorted(tuple(r) for r in df.select(self.bin.alias("b")).groupBy("b").count().collect())
        self.ids, self.sizes = [b for b, _ in counts], [c for _, c in counts]
        self.before = list(accumulate(self.sizes, initial=0))
        self.n = self.before.pop()

    def numbered(self, df: DataFrame) -> DataFrame:
        """df with _bin, each row's bin."""
        return df.withColumn("_bin", self.bin)

    def of(self, values: list) -> Column:
        """What a list, by bin, has for a row's _bin: a search in a literal, not a join."""
        return F.get(literal(values or [0]), below(self.ids, F.col("_bin")))

    def parts(self, least: int) -> list[int]:
        """A part for each bin: neighbouring bins together have at least so many rows, the last part excepted."""
        out, part, held = [], 0, 0
        for size in self.sizes:
            out.append(part)
            held += size
            if held >= least:
                part, held = part + 1, 0
        return out

    def runs(self, df: DataFrame, least: int, halo: int) -> DataFrame:
        """df's rows in runs (_run) of at least max(least, halo) rows, each with the last rows, at least halo, of the run before it, for which _own is false."""
        part = self.parts(max(least, halo, 1))
        until = list(part)
        for i, p in enumerate(part):
            if i and p != part[i - 1] and halo:
                k, held = i - 1, 0
                while k >= 0 and held < halo:
                    held += self.sizes[k]
                    until[k] = p
                    k -= 1
        return self._dealt(df, part, until)

    def _dealt(self, df: DataFrame, part: list[int], until: list[int]) -> DataFrame:
        """Rows in the run of their bin's part, and in those after it up to `until`."""
        # one search a row; own rows are told by their place, since a filter over _part would have the searches in the scan once more
        rows = self.numbered(df).withColumn("_place", below(self.ids, F.col("_bin")))
        part_of, until_of = (F.get(literal(v or [0]), F.col("_place")) for v in (part, until))
        rows = rows.select("*", F.posexplode(F.sequence(part_of, until_of)).alias("_nth", "_run"))
        return rows.withColumn("_own", F.col("_nth") == 0).drop("_bin", "_place", "_nth")
