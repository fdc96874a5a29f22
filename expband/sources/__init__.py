"""Readers, writers and the test-data views."""
