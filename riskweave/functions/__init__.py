"""Column expressions and scale primitives (exact quantile, global rank)."""
