"""Relational, graph, temporal and sampling operators: functions from DataFrames to DataFrames."""
