"""Quarry: retrieval and analytics over large document collections, as Spark DataFrame jobs."""
