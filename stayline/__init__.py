"""Cohort analytics on Spark: cohorts, time windows, features, scores, explanations."""

__version__ = "0.1.0"
