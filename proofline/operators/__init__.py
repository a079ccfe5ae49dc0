"""Operators with a ``DataFrame -> DataFrame`` interface."""
