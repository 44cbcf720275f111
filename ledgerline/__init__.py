"""Spark reports over order and line-item tables."""
