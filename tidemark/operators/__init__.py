"""Timeline, retrieval, catalog and verification operators."""
