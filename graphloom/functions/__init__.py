"""Scalar functions and operators over values."""
