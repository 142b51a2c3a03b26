"""Relational operators over events: matching, duplicates, changes, caps and checks."""
