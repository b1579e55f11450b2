"""Operators on DataFrames: chunking, deduplication, filters, splits, scores and format conversion."""
