"""Writing feedback tables."""
