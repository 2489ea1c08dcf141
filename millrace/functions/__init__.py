"""Part of the millrace engine."""
