"""Column expressions. Everything here is JVM-side; there is no Python UDF."""
