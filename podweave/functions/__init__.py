"""Column functions: built from Spark's own expressions, so they stay inside code generation."""
