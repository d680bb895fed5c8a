"""Operators: DataFrame in, DataFrame out; nothing is collected."""
