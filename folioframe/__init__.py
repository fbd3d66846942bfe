"""Bibliographic metadata and full-text analytics as Spark DataFrame operators."""
