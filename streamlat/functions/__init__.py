"""Column expressions; all of them built from JVM-side functions."""
