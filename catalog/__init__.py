"""Registered queries over the given tables, each with a SQL statement of the same result."""
