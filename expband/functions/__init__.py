"""Column expressions: rule signals, rule hits and numeric features."""
