"""Whole jobs: reports, and the queries over the driver's tables."""
