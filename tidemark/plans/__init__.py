"""Derived inputs."""
