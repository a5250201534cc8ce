"""Incremental forms of the aggregations."""
