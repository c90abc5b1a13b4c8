"""Preference-learning data jobs as Spark DataFrames."""
