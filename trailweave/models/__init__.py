"""models of the engine."""
