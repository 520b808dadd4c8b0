"""Column functions: text, similarity, numbers, geometry and intervals."""
