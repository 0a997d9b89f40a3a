"""Operators of a training-data pipeline: dedup, filters, packing, mixing, search and token counts."""
