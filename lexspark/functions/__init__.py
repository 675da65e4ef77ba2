"""Column-level functions (native Spark expressions)."""
