"""Operators of a training-data pipeline: deduplication, filters, formatting, token output, packing, mixing."""
