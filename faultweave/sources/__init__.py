"""Sources of the failure-chain library."""
