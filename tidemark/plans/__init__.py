"""Loads, sessions, exports and the registered queries."""
