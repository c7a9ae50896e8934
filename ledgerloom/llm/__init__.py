"""Operators for preparing training corpora with Spark.  Nothing else in the library imports this."""
