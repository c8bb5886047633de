"""Operators of a large training-data pipeline: packing, deduplication, scans, scoring, mixing, extraction."""
