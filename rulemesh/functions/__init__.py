"""Column expressions: URLs, rule patterns, error texts, page structure."""
