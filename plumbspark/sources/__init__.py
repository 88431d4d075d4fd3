"""Readers, metadata and query entry points."""
