"""Parquet reading, filtering, projecting and inspecting, expressed as plain Spark plans."""
