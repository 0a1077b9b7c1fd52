"""Reading, loading and exporting tables."""
