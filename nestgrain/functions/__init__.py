"""Column expressions: all built-in Catalyst functions, no UDFs."""
