"""Column functions: geometry, grid cells, identifiers."""
