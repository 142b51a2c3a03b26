"""Readers of registries and of collected documents."""
