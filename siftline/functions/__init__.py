"""Column functions and fixed values."""
