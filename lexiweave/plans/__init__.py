"""Conversion plans: lexicons composed into groups, chains and converters."""
