"""Domain tables."""
