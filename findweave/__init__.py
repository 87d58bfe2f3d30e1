"""Spark-first analytics for code-review findings, feedback and text corpora."""
