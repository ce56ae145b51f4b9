"""Operators of a large-scale training-data pipeline: dedup, filters, formatting, mixing."""
