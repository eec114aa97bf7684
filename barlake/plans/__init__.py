"""Registered queries over the supplied tables, and the SQL that gives the same rows."""

from barlake.plans.queries import ORACLE_SQL, QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
