"""Batch document search, evaluation and usage analytics as PySpark DataFrame operators.

Sub-packages
------------
``functions``  scalar helpers returning ``Column`` (text, metadata, citations, markup)
``sources``    readers and writers
``operators``  DataFrame-in, DataFrame-out operators
``plans``      compositions of operators (ingestion, batch search, evaluation sweep)
``streaming``  Structured Streaming variants of ingestion and usage
"""

__all__ = ["functions", "operators", "plans", "session", "sources", "streaming"]
