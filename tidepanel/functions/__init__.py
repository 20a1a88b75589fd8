"""Column expressions: rolling kernels, recursive kernels, option prices, ratios."""
