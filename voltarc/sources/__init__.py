"""Telemetry readers, the telemetry derived from the event table, and stage tables."""
