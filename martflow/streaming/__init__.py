"""martflow streaming."""
