"""Named report plans and the registered query catalog."""
