"""Plans of the sensor jobs."""
