"""Registered queries: derived sequence views over the given tables, and SQL to hold them against."""
