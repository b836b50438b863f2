"""Facts, items and checks."""
