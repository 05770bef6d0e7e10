"""Registered queries: each module has QUERIES (name to function of session and folder) and ORACLE_SQL (name to the same in SQL)."""
