"""martflow functions."""
