"""Readers, writers and the boundaries to libraries and services outside Spark."""
