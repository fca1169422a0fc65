"""Scalar functions and random numbers."""
