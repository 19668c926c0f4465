"""tidemark: telemetry, findings and corpus analytics expressed as Spark jobs."""
