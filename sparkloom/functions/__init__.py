"""Column functions; all stay in generated code."""
