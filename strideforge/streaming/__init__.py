"""Streaming of the sensor jobs."""
