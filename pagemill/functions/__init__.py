"""functions of pagemill."""
