"""Spark-native telemetry root-cause analytics."""
