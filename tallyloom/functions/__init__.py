"""Column expressions: everything here is JVM-side and row-local."""
