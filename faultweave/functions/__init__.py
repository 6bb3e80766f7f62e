"""Functions of the failure-chain library."""
