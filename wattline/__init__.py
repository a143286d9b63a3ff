"""Telemetry analytics on Spark: lazy DataFrame operators over register readings."""

__version__ = "0.1.0"
