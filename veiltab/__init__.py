"""Tabular release, utility audit and disclosure-risk audit as Spark DataFrame jobs."""
