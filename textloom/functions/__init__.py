"""Column expressions and small plan helpers shared by the operators."""
