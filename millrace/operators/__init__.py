"""Relational and sequence operators over DataFrames."""
