"""Tables to files."""
