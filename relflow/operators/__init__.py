"""Lowering of plan nodes to DataFrames."""
