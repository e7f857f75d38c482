"""cli of the engine."""
