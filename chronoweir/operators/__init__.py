"""Operators on ordered series: features, scaling, splits, leakage checks, contexts, forecasts and backtests."""
