"""Sinks of the evidence library."""
