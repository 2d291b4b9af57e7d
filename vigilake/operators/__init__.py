"""Operators of the moderation engine."""
