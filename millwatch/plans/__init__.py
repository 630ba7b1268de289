"""Reports and gold tables."""
