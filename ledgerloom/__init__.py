"""Household ledger analytics as PySpark jobs."""
