"""Functions of the evidence library."""
