"""Operators: DataFrame (and parameters) in, DataFrame or tree model out."""
