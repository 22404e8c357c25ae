"""Registered queries with their DuckDB equivalents, by subject. A module has QUERIES and SQL."""
