"""Incremental scoring of arriving posting files."""
