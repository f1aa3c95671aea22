"""Retrieval, graph and library analytics over document collections, on Spark."""
