"""Queries over the tables, and named actions."""
