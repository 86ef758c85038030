"""Column functions: projection, cluster ids, styling."""
