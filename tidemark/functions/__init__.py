"""Scalar building blocks: regular-expression dialect, time zones, field extraction and labels."""
