"""Panels of market-style time series on Spark: bars, repair, features, selection, back-tests."""
