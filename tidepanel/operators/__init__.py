"""Relational operators that Spark lacks or that need care: as-of joins, split adjustment, portfolio alignment."""
