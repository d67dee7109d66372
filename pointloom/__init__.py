"""pointloom: a PySpark-native analytics library for layered, time-varying 3D point content."""
