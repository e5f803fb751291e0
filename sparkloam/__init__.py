"""Batch analytics on DataFrames: sorting, graphs, clustering, tuning, exchanges, metrics."""
