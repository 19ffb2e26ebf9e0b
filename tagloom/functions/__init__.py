"""Column functions over sequences, qualities and headers."""
