"""Column builders: expressions only, no data movement."""
