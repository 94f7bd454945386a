"""Column functions over paths and texts."""
