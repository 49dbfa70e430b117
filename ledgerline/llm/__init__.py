"""Operators for preparing training data: duplicate removal, filtering, extraction, search, packing.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames; Python code
works on Arrow batches inside tasks, and Spark does the partitioning, shuffling and aggregation.
"""
