"""The queries, from lines to results, on tables and streams alike."""
