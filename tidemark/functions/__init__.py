"""Column expressions: no operator here needs a shuffle."""
