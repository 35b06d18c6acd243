"""Relational and search operators: DataFrame in, DataFrame out."""
