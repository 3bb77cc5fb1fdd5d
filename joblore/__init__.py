"""Spark jobs over job-execution logs."""
