"""Query plans over the sample tables."""
