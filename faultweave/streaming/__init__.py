"""Streaming of the failure-chain library."""
