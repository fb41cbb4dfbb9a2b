"""Column expressions; all of them run on the JVM."""
