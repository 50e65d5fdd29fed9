"""Readers that turn log files into normalised timeline rows."""
