"""Functions of the moderation engine."""
