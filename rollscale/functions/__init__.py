"""Column builders and the numpy helpers that share their formulas."""
