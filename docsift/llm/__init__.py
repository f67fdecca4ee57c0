"""Operators of a training-data pipeline: search, deduplication, mixing, filtering, extraction.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
