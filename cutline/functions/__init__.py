"""Column expressions. Nothing here runs an action or leaves the JVM."""
