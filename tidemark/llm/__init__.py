"""Operators for building training corpora.

Every operator takes a ``documents``-like DataFrame, reads the columns it names and ignores the rest,
so further columns of any name are harmless.  Nothing outside this subpackage imports it.
"""
