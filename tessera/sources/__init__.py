"""Sequence files, stored indexes and result files."""
