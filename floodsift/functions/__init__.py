"""Column functions; all stay inside Spark's generated code."""
