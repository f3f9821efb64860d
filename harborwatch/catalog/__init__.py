"""The named queries of the engine."""
