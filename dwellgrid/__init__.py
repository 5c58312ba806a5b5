"""Spark operators for tables of instrument readings over time and channel."""
