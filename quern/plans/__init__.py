"""The registered queries: each applies an operator to the given tables."""
