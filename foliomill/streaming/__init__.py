"""streaming of foliomill."""
