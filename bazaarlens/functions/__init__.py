"""Column expressions: metric rules with no plan of their own."""
