"""Operators of a training-data pipeline: cleaning, scoring, de-duplication, tokens, shards and mixes.

Nothing else in the library imports this subpackage; its queries are in ``corpusmill.llm.queries``.
"""
