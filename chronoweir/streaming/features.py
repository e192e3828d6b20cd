"""Lags, rolling and exponential means of keyed streams.

Each series keeps its last values, as many as the features look back, and its exponential means. Rows of a micro-batch are taken in the order of time; rows behind a series' last time come too late and are dropped, so a replayed stream gives what the batch operators give.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.features import ema_name, lag_name, normalize_lags, rolling_name


def stream_features(stream: DataFrame, key: str, time_col: str, value_col: str, lags: Sequence[int] = (), rolling: Sequence[int] = (), alphas: Sequence[float] = ()) -> DataFrame:
    """(key, time, value, features) of a stream, by key."""
    lags, rolling, alphas = normalize_lags(lags), list(rolling), list(alphas)
    keep = max([1, *lags, *rolling])
    names = [*(lag_name(value_col, k) for k in lags), *(rolling_name(value_col, w) for w in rolling), *(ema_name(value_col, a) for a in alphas)]
    schema = T.StructType([*(stream.schema[c] for c in (key, time_col, value_col)), *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(k, frames, state):
        import pandas as pd

        last, text = state.get if state.exists else (None, "[[], []]")
        values, means = json.loads(text)
        means = means or [None] * len(alphas)
        rows = pd.concat(list(frames)).sort_values(time_col, kind="stable")
        stamps = rows[time_col].astype("int64") if rows[time_col].dtype.kind == "i" else rows[time_col].astype("datetime64[us]").astype("int64")
        out = []
        for stamp, moment, x in zip(stamps, rows[time_col], rows[value_col], strict=True):
            if last is not None and stamp < last:
                continue
            last, x = int(stamp), None if pd.isna(x) else float(x)
            values.append(x)
            made = [values[-1 - j] if j < len(values) else None for j in lags]
            for w in rolling:
                part = values[-w:]
                made.append(sum(part) / w if len(part) == w and None not in part else None)
            if x is not None:
                means = [x if m is None else a * x + (1 - a) * m for a, m in zip(alphas, means, strict=True)]
            made += [m if x is not None else None for m in means]
            del values[: max(0, len(values) - keep - 1)]
            out.append((k[0], moment, x, *made))
        state.update((last, json.dumps([values, means])))
        if out:
            yield pd.DataFrame(out, columns=schema.names)

    grouped = stream.select(key, time_col, value_col).groupBy(key)
    return grouped.applyInPandasWithState(run, schema, "last long, kept string", "append", GroupStateTimeout.NoTimeout)


def windowed_means(stream: DataFrame, time_col: str, value_col: str, width: str, late: str, keys: Sequence[str] = (), slide: str | None = None) -> DataFrame:
    """Counts and means by time window; windows close when the watermark passes them."""
    span = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    return stream.withWatermark(time_col, late).groupBy(span, *keys).agg(F.count(value_col).alias("n"), F.avg(value_col).alias("mean"))
