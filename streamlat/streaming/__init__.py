"""Running the queries as streams."""
