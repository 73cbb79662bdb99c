"""Column expressions: everything here is a plain Catalyst expression."""
