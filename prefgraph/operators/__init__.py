"""Operators on preference data: DataFrame in, DataFrame out."""
