"""Cohort aggregates over streams."""
