"""Operators over array data as DataFrames."""
