"""Structured Streaming twins of the log, telemetry and scoring operators."""
