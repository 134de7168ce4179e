"""Structured Streaming forms of the intake and of the daily means."""
