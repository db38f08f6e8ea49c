"""SQL functions over a dictionary."""
