"""sources of foliomill."""
