"""Whole pipelines, reports, and the registered queries with their SQL."""
