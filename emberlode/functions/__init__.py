"""Column functions over paths, text and vectors."""
