"""Spark-first analytics for personal-productivity data: DataFrame in, DataFrame out."""
