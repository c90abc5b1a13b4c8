"""Queries over the tables: an adapter for each domain view, a query for each operator, and its SQL."""
