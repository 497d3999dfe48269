"""The curation store's statements, and the named queries."""
