"""PDF bytes to objects and back, without Spark: what runs inside the workers."""
