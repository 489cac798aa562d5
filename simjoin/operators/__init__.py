"""Join, aggregation and evaluation operators."""
