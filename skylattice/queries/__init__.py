"""Registered queries: each operator on the driver's tables, with the SQL that says the same."""
