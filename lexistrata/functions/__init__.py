"""Column functions: expressions that stay on the JVM side."""
