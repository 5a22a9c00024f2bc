"""Registered queries: each pairs a Spark callable with the SQL a single-node engine runs on the same tables."""
