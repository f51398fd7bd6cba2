"""DataFrame -> DataFrame steps for `df.transform(...)`, the same on tables and streams."""
