"""Table and manifest readers and writers."""
