"""Plans of the moderation engine."""
