"""Market-panel analytics expressed as Spark DataFrame plans."""
