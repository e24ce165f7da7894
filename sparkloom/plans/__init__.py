"""Queries: operators of the package applied to the tables, each with the same in SQL."""
