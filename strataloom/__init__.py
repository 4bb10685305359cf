"""Spark-first analytics for text and source-code corpora."""
