"""Operational and knowledge analytics as Spark DataFrame, SQL and streaming operators."""
