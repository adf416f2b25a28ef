"""Continuous queries."""
