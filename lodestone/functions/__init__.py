"""Column builders: expressions that Catalyst sees."""
