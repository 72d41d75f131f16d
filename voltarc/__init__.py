"""Battery telemetry analytics on Spark: cycles, health labels, phases, missions, models."""
