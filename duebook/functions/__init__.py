"""Column expressions. Every function takes and returns Spark columns."""
