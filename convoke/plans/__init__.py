"""Whole plans: a scan from documents to ranked events, stored state and output."""
