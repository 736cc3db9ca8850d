"""martflow plans."""
