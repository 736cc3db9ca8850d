"""martflow sources."""
