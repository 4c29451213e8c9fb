"""Column helpers: every function takes and returns Columns and stays in generated JVM code."""
