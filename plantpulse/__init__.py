"""Telemetry analytics for industrial plants, expressed as Spark DataFrame operators."""
