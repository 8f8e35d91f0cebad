"""Operators of a training-data pipeline: language, quality, duplicates, leaks, tokens, packing."""
