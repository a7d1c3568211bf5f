"""Engram: engineering-memory retrieval and corpus processing as Spark plans."""
