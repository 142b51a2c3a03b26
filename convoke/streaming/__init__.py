"""Scans as micro-batches."""
