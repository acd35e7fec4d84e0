"""Spark-native analytics for vehicle trajectories."""
