"""Repository insight on Spark."""
