"""Document and fact analytics on Spark."""
