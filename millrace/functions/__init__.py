"""Column functions: text cleaning, personal data, quality gates, hashes and set similarity."""
