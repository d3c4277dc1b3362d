"""Operators for large text corpora, their queries and their checks. Nothing outside this folder imports it."""
