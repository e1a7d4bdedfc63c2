"""Behaviour-pattern mining over execution traces, on Spark DataFrames."""

__version__ = "0.1.0"
