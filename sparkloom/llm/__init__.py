"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; what must be kept between jobs is written as Parquet below the
folder that the session names in ``spark.checkpoint.dir``.
"""
