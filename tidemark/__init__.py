"""A point-in-time research engine on Spark."""
