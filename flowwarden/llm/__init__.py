"""Operators of a training-data pipeline: chat formatting, licence scans, packing, fingerprints,
deduplication, mixing, vector search, toxicity and secret scans. Nothing outside imports this package."""
