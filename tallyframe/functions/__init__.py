"""Column functions: each builds a Spark expression, none leaves the JVM."""
