"""Relational, graph, rewriting and data-cleaning operators over DataFrames."""
