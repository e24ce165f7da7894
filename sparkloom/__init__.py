"""A PySpark-native analytics and retrieval engine: DataFrames in, DataFrames out."""
