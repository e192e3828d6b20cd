"""Fixed-length context windows and batches of rows."""


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spec import SeriesSpec


def _sizes(**sizes: int) -> None:
    for name, n in sizes.items():
        if n <= 0:
            raise ValueError(f"{name} must be positive")


def contexts(df: DataFrame, spec: SeriesSpec, column: str, length: int, stride: int = 1) -> DataFrame:
    """(series keys, start, context): the arrays of `length` values that begin at 0, stride, 2 stride and so on. Nulls stay in their places."""
    _sizes(length=length, stride=stride)
    rows = spec.indexed(df, "_i")
    if spec.partition_cols:
        keys, within = list(spec.partition_cols), Window.partitionBy(*spec.partition_cols).orderBy("_i")
    else:
        # one long series: runs of rows, each with the first rows of the next
        size = max(length, 100_000)
        run = F.floor(F.col("_i") / size)
        both = F.when((F.col("_i") % size < length - 1) & (run > 0), F.array(run, run - 1)).otherwise(F.array(run))
        rows = rows.withColumn("_run", F.explode(both))
        keys, within = [], Window.partitionBy("_run").orderBy("_i")
    values = F.collect_list(F.struct(F.col(column).alias("v"))).over(within.rowsBetween(0, length - 1))
    rows = rows.select(*keys, *(["_run"] if not keys else []), F.col("_i").alias("start"), F.transform(values, lambda s: s["v"]).alias("context"))
    rows = rows.filter((F.size("context") == length) & (F.col("start") % stride == 0))
    return rows if keys else rows.filter(F.col("_run") == F.floor(F.col("start") / size)).drop("_run")


def context_rows(df: DataFrame, spec: SeriesSpec, column: str, length: int, stride: int = 1) -> DataFrame:
    """The same as rows (series keys, start, step, value)."""
    return contexts(df, spec, column, length, stride).select(*spec.partition_cols, "start", F.posexplode("context").alias("step", "value"))


def shortest(df: DataFrame, spec: SeriesSpec) -> int:
    """Rows of the shortest series."""
    spec.check(df)
    return df.groupBy(*spec.partition_cols).count().agg(F.min("count")).first()[0] or 0


def _enough(df: DataFrame, spec: SeriesSpec, length: int) -> None:
    if (n := shortest(df, spec)) < length:
        raise ValueError(f"Need at least {length} rows, got {n}")


def context_view(df: DataFrame, spec: SeriesSpec, length: int, start: int = 0, check: bool = False) -> DataFrame:
    """The rows start to start + length of each series; with check, a series that ends before is an error."""
    _sizes(length=length)
    if start < 0:
        raise ValueError(f"Invalid start {start}")
    if check and start + length > (n := shortest(df, spec)):
        raise ValueError(f"Invalid start {start}: {n} rows have no {length} from there")
    return spec.indexed(df, "_i").filter((F.col("_i") >= start) & (F.col("_i") < start + length)).drop("_i")


def latest_context(df: DataFrame, spec: SeriesSpec, length: int, check: bool = False) -> DataFrame:
    """The last `length` rows of each series; with check, shorter series are an error."""
    _sizes(length=length)
    spec.check(df)
    if check:
        _enough(df, spec, length)
    if not spec.partition_cols:
        return df.orderBy(*(F.col(c).desc() for c in spec.order)).limit(length)
    back = Window.partitionBy(*spec.partition_cols).orderBy(*(F.col(c).desc() for c in spec.order))
    return df.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= length).drop("_back")


def batch_ids(df: DataFrame, spec: SeriesSpec, size: int, name: str = "batch_id") -> DataFrame:
    """df with the number of each row's batch of `size` rows."""
    _sizes(batch_size=size)
    return spec.indexed(df, "_i").withColumn(name, F.floor(F.col("_i") / size)).drop("_i")


def stream_batches(df: DataFrame, spec: SeriesSpec, size: int):
    """Lists of rows, `size` at a time, in order; partitions come to the driver one by one."""
    _sizes(batch_size=size)
    held = []
    for row in df.orderBy(*spec.keys).toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


class ContextBridge:
    """Contexts of a series for a forecasting model: an object with predict(context, horizon)."""

    def __init__(self, spec: SeriesSpec, column: str, context_length: int = 512, prediction_length: int = 64, stride: int = 1):
        _sizes(context_length=context_length, prediction_length=prediction_length, stride=stride)
        self.spec, self.column = spec, column
        self.context_length, self.prediction_length, self.stride = context_length, prediction_length, stride

    def contexts(self, df: DataFrame) -> DataFrame:
        _enough(df, self.spec, self.context_length)
        return contexts(df, self.spec, self.column, self.context_length, self.stride)

    def context_view(self, df: DataFrame, start: int = 0) -> DataFrame:
        return context_view(df, self.spec, self.context_length, start, check=True)

    def latest_context(self, df: DataFrame) -> DataFrame:
        return latest_context(df, self.spec, self.context_length, check=True)

    def predict(self, model, df: DataFrame, *, horizon: int | None = None) -> DataFrame:
        """(series keys, forecast) from the latest context of each series."""
        last = self.latest_context(df)
        values = F.array_sort(F.collect_list(F.struct(*self.spec.order, F.col(self.column).alias("_v"))))
        rows = last.groupBy(*self.spec.partition_cols).agg(F.transform(values, lambda s: s["_v"]).alias("context"))
        return self._forecast(model, rows, horizon).drop("context")

    def predict_batch(self, model, df: DataFrame, *, horizon: int | None = None) -> DataFrame:
        """The same for every context, by (series keys, start)."""
        return self._forecast(model, self.contexts(df), horizon).drop("context")

    def _forecast(self, model, rows: DataFrame, horizon: int | None) -> DataFrame:
        steps = horizon or self.prediction_length

        @F.pandas_udf("array<double>")
        def forecast(context):
            return context.map(lambda c: [float(x) for x in model.predict(c, steps)])

        return rows.withColumn("forecast", forecast("context"))
