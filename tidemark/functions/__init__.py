"""Scalar expressions and codecs."""
