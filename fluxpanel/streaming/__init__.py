"""Incremental upkeep of monthly tables with Structured Streaming."""
