"""Operators over journals, commands and states."""
