"""Strict readers, and publication of results."""
