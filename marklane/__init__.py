"""Spark-native analytics for time-aligned interval annotations.

Every operator takes and returns DataFrames; nothing is collected unless the
docstring of the operator says so.
"""
