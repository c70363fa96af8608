"""Order-book snapshot analytics on Spark."""
