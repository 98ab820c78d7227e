"""Workflow-telemetry analytics as PySpark DataFrame operators."""
