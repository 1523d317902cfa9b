"""Renderings of a result."""
