"""Operators over DataFrames. Files come as (path, text); findings have the columns of FINDING."""
