"""Sketch similarity on Spark."""
