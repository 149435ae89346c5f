"""operators of foliomill."""
