"""Table schemas, readers, writers and checks."""
