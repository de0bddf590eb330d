"""Column builders shared by operators."""
