"""Column expressions and fixed value lists shared by the operators."""
