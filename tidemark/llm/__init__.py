"""Operators of a training-data pipeline: mixing, tokens, search, near duplicates, scoring, extraction, scans, quality."""
