"""Corpus quality analytics and training-data preparation on Spark."""
