"""Readers and writers of texts and JSON lines."""
