"""Column expressions: folding, extraction and labels."""
