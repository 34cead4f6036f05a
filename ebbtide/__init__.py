"""Retention-risk analytics on Spark DataFrames.

Sub-packages: ``sources`` (tables in and out), ``functions`` (column expressions), ``operators`` (DataFrame
operators and ``pyspark.ml`` stages), ``plans`` (multi-step jobs), ``streaming`` (incremental scoring) and
``catalog`` (the registered queries with their check SQL).
"""
