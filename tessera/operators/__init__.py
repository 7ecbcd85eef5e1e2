"""Operators: functions from DataFrames and typed parameters to DataFrames."""
