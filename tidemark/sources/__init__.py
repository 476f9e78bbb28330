"""Readers, parsers and sinks at the edges of the engine."""
