"""Column -> Column expressions; all built-in, none leaves the JVM."""
