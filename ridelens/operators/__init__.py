"""Column-parameterised DataFrame → DataFrame operators."""
