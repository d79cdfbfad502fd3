"""Structured Streaming forms of the run-status operators."""
