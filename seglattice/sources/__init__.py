"""Dictionary and text sources."""
