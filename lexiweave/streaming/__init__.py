"""Conversion over streams."""
