"""plans of foliomill."""
