"""Incremental forms of the additive statistics."""
