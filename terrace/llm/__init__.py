"""Operators for training-data pipelines. Nothing outside this package imports it.

All take a DataFrame and the names of the columns they use; other columns are ignored, whatever their names.
"""
