"""Cohort evidence operators on Spark: DataFrame in, DataFrame out."""
