"""Column expressions: every function takes and returns a Column, so it stays inside the JVM."""
