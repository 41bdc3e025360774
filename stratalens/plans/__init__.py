"""Whole studies, and their binding to concrete tables."""
