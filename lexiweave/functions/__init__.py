"""Scalar text functions: pure Python in ``text``, columns in ``columns``."""
