"""Spark-native statistical-genetics analytics over cohort tables."""
