"""Composite cohort operators."""
