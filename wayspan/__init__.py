"""Spark-native analytics on places, schedules, networks and pixel grids."""
