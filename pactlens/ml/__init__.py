"""Clause classifiers on Spark ML."""
