"""Part of the trajectory engine."""
