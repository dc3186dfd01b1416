"""Plans of the evidence library."""
