"""Queries over the evaluation tables, each with the SQL that it is held against."""
