"""Retrieval, ranking and corpus analytics on Spark."""
