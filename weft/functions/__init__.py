"""Column expressions (JVM-side built-ins; pandas UDFs only where needed)."""
