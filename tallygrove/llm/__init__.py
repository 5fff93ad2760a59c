"""Operators for building training corpora, each over whole tables.

Nothing outside this subpackage imports it; the folder can be deleted.
"""
