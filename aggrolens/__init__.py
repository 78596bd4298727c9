"""Text-aggression analytics on Spark."""
