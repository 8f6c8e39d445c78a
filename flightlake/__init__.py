"""Flight and telemetry log analytics as Spark DataFrame jobs, keyed by ``log_id``."""
