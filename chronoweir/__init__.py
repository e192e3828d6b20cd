"""Leakage-aware time-series features, splits, backtests and audits on Spark DataFrames."""
