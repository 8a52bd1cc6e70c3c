"""Operators on DataFrames: catalog building, tiered matching, labels."""
