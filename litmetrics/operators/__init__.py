"""Relational operators of the analysis; every function takes and returns DataFrames or Columns."""
