"""Operators for training-data pipelines: fingerprints, sampling, deduplication, parsing, filtering, tokenising.

Nothing outside this folder imports it.
"""
