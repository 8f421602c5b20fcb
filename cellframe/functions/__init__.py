"""Column functions: each takes and returns Spark columns and stays in generated code."""
