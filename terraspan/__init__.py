"""Subsurface and training-data analytics as Spark DataFrame queries."""
