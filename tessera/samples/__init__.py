"""A whole application over the engine."""
