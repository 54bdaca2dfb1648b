"""The queries the driver runs and the SQL they are checked against."""
