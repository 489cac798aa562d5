"""Joins of a stream of queries with a static database."""
