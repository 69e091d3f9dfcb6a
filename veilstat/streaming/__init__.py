"""Reports as streams."""
