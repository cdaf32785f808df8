"""Workload-triage analytics over warehouse query telemetry, on Spark."""
