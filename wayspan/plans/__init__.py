"""Queries: operators bound to the tables, with the SQL that they must agree with."""
