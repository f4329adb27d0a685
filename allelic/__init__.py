"""Spark-native analytics for sequence variants in standard nomenclature."""
