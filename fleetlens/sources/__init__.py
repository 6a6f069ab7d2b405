"""Readers and writers for telemetry tables."""
