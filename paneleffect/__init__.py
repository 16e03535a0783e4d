"""Spark-native measurement of incremental effects on panel data."""
