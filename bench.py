"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

value is the sum of the medians of the warm runs. Each query's rows are written to the `noop` sink; `shuffle_mb` and `spill_mb` are what a warm run wrote to shuffle files and spilled. With DuckDB's SQL for a query, `duckdb` has the median of its runs on the same files.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent))
from chronoweir.plans import catalog  # noqa: E402

HEADLINE = ["feature_window_multi", "lag_global", "ema_03", "rolling_mean_7d", "expanding_folds", "leakage_similarity", "context_windows", "robust_scale"]
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.retainedStages", "100000").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(f) -> float:
        began = time.perf_counter()
        f()
        return time.perf_counter() - began

    def written() -> tuple[float, float]:
        """MB of all stages so far: shuffle files, spill to disk."""
        gateway = spark.sparkContext._gateway
        none, share = gateway.jvm.java.util.ArrayList(), gateway.new_array(gateway.jvm.double, 0)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, share, none)
        found = [(s.shuffleWriteBytes(), s.diskBytesSpilled()) for s in (stages.apply(i) for i in range(stages.size()))]
        return sum(a for a, _ in found) / 1e6, sum(b for _, b in found) / 1e6

    queries, cold, duck, rows, shuffle, spill = {}, {}, {}, {}, {}, {}
    for name in HEADLINE:
        go = lambda f=catalog.QUERIES[name]: f(spark, sf).write.format("noop").mode("overwrite").save()
        cold[name] = round(timed(go), 3)
        queries[name] = round(statistics.median(timed(go) for _ in range(RUNS)), 3)
        rows[name] = catalog.QUERIES[name](spark, sf).count()
        before = written()
        go()
        shuffle[name], spill[name] = (round(b - a, 2) for a, b in zip(before, written(), strict=True))
    try:
        import duckdb
    except ImportError:
        duckdb = None
    if duckdb and os.environ.get("BENCH_DUCKDB", "1") == "1":
        con = duckdb.connect(config={"threads": int(cpus)})
        for p in Path(sf).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
        for name in HEADLINE:
            duck[name] = round(statistics.median(timed(lambda q=catalog.SQL[name]: con.execute(q).fetchnumpy()) for _ in range(RUNS)), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "cold": cold, "duckdb": duck, "rows": rows, "shuffle_mb": shuffle, "spill_mb": spill, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
