"""Operators of a training-data pipeline: sharding, extraction, duplicate
search, quality rules, decontamination, secret scans, tokenising, language id.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
