"""Failure detection and root-cause chains over log tables, on Spark."""
