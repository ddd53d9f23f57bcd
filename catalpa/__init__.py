"""Spark jobs over schema snapshots, the rows behind them, and text corpora."""
