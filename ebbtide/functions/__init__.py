"""Column expressions; all are built-in Spark expressions that stay inside generated code."""
