"""Operators of the evidence library."""
