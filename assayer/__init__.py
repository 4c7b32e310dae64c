"""Dataset-quality analytics on Spark."""
