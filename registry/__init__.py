"""Registered queries with the SQL that checks them, one module per area."""
