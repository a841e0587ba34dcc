"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; Spark partitions and shuffles the rows and numpy does the work
inside a task.
"""
