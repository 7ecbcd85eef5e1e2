"""Change data capture, versioned tables, windows and stored jobs."""
