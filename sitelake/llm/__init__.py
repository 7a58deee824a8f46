"""Operators for training-data pipelines: filters, scores, duplicates, tokens and packing.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
