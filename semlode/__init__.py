"""Semantic retrieval and ranking on Spark."""
