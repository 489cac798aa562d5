"""Operators that a training-data pipeline needs beside the similarity joins.

Nothing outside this package imports it; ``simjoin.llm.queries`` lists its queries.
"""
