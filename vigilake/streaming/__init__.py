"""Streaming of the moderation engine."""
