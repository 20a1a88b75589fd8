"""Plans: feature requests, universes, fundamentals and model evaluation."""
