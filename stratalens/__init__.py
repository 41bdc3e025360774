"""Cohort and outcome analytics as lazy PySpark DataFrame transformations."""
