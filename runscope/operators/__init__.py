"""Analytic operators: DataFrame in, lazy DataFrame out."""
