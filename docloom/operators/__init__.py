"""Operators: DataFrame to DataFrame functions."""
