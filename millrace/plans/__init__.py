"""Whole jobs built of the operators: export, sanitising, generation and their configuration."""
