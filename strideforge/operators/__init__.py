"""Operators of the sensor jobs."""
