"""Sub-word corpus analytics as Spark DataFrame operations."""
