"""Part of the scholia engine."""
