"""martflow operators."""
