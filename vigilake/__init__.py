"""vigilake: moderation analytics and training-data operators on PySpark."""
