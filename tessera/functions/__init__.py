"""Column functions: text and scoring."""
