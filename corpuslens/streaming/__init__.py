"""Reports over streams."""
