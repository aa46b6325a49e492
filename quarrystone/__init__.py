"""Document ingestion and governed reading on Spark."""
