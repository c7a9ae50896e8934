"""Statements as a stream of files."""
