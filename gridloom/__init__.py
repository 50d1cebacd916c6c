"""Grid pattern analytics on Spark."""
