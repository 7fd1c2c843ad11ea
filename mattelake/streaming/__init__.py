"""Growing folders as streams."""
