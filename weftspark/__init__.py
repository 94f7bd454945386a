"""Spark-native audit and telemetry analytics over DataFrames."""
