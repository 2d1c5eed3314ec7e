"""PySpark text security: scan, redact, count, decide and report over tables and streams."""
