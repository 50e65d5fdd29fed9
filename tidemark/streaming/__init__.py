"""Continuous ingestion of arriving files."""
