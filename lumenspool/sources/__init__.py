"""Sources of the evidence library."""
