"""Fleet-telemetry analytics on Spark: ingest, detection, root cause, topology, health."""
