"""Convoke: event discovery and ranking over web documents, as Spark plans."""
