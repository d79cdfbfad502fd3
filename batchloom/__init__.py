"""Tagged-batch table runs on Spark."""
