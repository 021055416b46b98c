"""operators of pagemill."""
