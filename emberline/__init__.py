"""Thermal hotspot analytics and corpus preparation on Spark."""
