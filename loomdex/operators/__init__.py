"""Relational, search, graph, packing, reduction and delta operators: DataFrames to DataFrames."""
