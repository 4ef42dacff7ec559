"""Functions of the sensor jobs."""
