"""Operators of a training-data pipeline: one module for each, and the queries registered for them.

Nothing outside this package and ``corpus_pipeline`` imports it.
"""
