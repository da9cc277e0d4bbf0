"""Operators of a training-data pipeline: tokens, deduplication, quality, language, mixing, search, fingerprints, URLs."""
