"""A PySpark-native analytics engine for particle-tracking data."""
