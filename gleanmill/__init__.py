"""Evidence analytics as DataFrame, SQL and Structured Streaming jobs."""
