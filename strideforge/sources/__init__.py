"""Sources of the sensor jobs."""
