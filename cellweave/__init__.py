"""Spatial and delivery-data analytics as plain Spark DataFrame jobs."""
