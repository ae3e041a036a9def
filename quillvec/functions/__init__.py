"""Column functions over text and vectors."""
