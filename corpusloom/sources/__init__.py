"""Table and text sources."""
