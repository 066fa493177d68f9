"""Operators a large-scale training-data pipeline needs, one module each, plus their registered queries.

Nothing outside this folder imports it; ``corpus_pipeline.py`` and ``tests/llm`` use it.
"""
