"""Saturation-telemetry analytics as Spark DataFrame plans."""
