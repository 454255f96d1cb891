"""Scalar functions and aggregates with the engine's null rules."""
