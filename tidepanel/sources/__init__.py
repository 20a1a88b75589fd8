"""Readers, writers and the panel that the driver's tables stand in for."""
