"""Spark jobs that keep very large file catalogues correct and readable."""
