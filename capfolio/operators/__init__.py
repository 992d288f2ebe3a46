"""Derived tables and analytic operators: functions from DataFrames to a DataFrame."""
