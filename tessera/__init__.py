"""Retrieval and decision analytics on Spark."""
