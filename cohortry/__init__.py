"""Cohort analytics as composable Spark DataFrame operators."""

from cohortry.session import checkpoint, configure

__all__ = ["checkpoint", "configure"]
