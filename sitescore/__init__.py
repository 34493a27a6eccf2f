"""Sensor-placement design and measurement analytics as Spark jobs."""
