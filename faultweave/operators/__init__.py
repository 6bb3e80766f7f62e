"""Operators of the failure-chain library."""
