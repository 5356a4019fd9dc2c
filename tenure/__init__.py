"""tenure: temporal HR analytics on Spark."""
