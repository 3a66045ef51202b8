"""Operators for training-data pipelines: tokens, duplicates, quality, language, search, packing, sharding."""
