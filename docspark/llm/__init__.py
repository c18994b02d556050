"""Operators of a training-data pipeline: joins, fingerprints, deduplication, models, mixing, packing and sharding."""
