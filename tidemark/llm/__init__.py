"""Operators for training-data pipelines: text, tokens, pages, media and conversations.

Nothing outside this package imports it; ``tidemark.llm.queries`` holds the
query registry that ``__spark_entry__`` adds when the package is present.
"""
