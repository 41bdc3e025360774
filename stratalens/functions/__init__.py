"""Column-name logic and column expressions."""
