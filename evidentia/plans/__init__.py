"""Registered queries over the driver tables, and the SQL that gives the same rows."""
