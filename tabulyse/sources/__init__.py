"""Files to tables."""
