"""Streaming of the evidence library."""
