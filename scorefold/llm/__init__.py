"""Operators for training-data pipelines: packing, scoring, formatting and near-duplicate search on Spark."""
