"""Queries over the test tables, their SQL, and end-to-end flows."""
